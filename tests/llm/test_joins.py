"""Similarity join by PartEnum and exact links in blocks, against all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import block_links, fetch, jaccard_join, near_dup
from tests.llm.helpers import DOCS, LONG, awkward, docs, empty, fresh, shingle_set


def brute_components(texts, ids=None, limit=(80, 100)):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts))) if ids is None else list(ids)
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and limit[1] * len(sets[i] & sets[j]) >= limit[0] * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def edited(rng, words, n):
    """The words with so many scattered, inserted, cut or appended."""
    words = list(words)
    for _ in range(n):
        at = int(rng.integers(0, max(1, len(words))))
        kind = rng.integers(0, 3)
        if kind == 0:
            words[at : at + 1] = [f"e{rng.integers(0, 10**6)}"]
        elif kind == 1:
            words.insert(at, f"e{rng.integers(0, 10**6)}")
        else:
            del words[at : at + 1]
    return words


@pytest.mark.parametrize("sizes", [(4, 12), (20, 60), (150, 500)])
def test_similar_sets_share_a_signature(sizes):
    """Pairs near the limit, many with empty cells, always meet; and few others do."""
    rng = np.random.default_rng(sizes[0])
    bands = jaccard_join.Bands(4, 5)
    near = 0
    for _ in range(400):
        n = int(rng.integers(*sizes))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        gone, new = int(rng.integers(0, n // 5 + 2)), int(rng.integers(0, n // 5 + 2))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[gone:n], pool[n : n + new])))
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
            near += 1
            assert set(jaccard_join.signatures(a, bands).tolist()) & set(jaccard_join.signatures(b, bands).tolist())
    assert near > 50
    others = [set(jaccard_join.signatures(np.unique(rng.integers(0, 1 << 63, int(rng.integers(*sizes)), dtype=np.uint64)), bands).tolist()) for _ in range(200)]
    assert not any(a & b for a, b in itertools.combinations(others, 2))


def test_bands_hold_all_similar_sizes():
    bands = jaccard_join.Bands(4, 5)
    for a in range(1, 400):
        for b in range(a, a * 5 // 4 + 1):
            assert bands.of(b) - bands.of(a) in (0, 1)
            least = -(-4 * (a + b) // 9)  # elements in common
            assert a + b - 2 * least <= min(bands.apart_in(x, bands.of(b)) for x in (a, b))


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(31)
    base = [fresh(rng, n) for n in (3, 4, 6, 9, 15, 30, 60, 120, 300, 700)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(edited(rng, b, max(1, int(share * len(b))))))
        texts.append(" ".join([*b, *fresh(rng, len(b) // 5)]))
        texts.append(" ".join(b[len(b) // 6 :]))
    texts += [None, "", " \n", texts[5].upper(), texts[9], "one", "ONE", "one two", LONG, LONG + "x"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, *texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_texts_of_one_frame_are_told_apart(spark):
    """Many texts just below and above the limit, all of which meet in keys."""
    rng = np.random.default_rng(32)
    frame = fresh(rng, 200)
    texts = [" ".join([*frame, *fresh(rng, 30 if k % 10 else 23)]) for k in range(120)]  # 196 common of 256, 249 or 242
    got = [(r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert got == brute_components(texts)
    assert 2 < len({c for _, c in got}) < 120


def test_parities_never_lose_a_similar_pair(spark):
    """Sets of sizes with different numbers of cells, against all pairs; and few pairs well below the limit stay."""
    rng = np.random.default_rng(33)
    core = rng.integers(0, 1 << 62, 700)
    sets = [np.unique(np.concatenate((core[int(rng.integers(0, 200)) : int(rng.integers(500, 700))], rng.integers(0, 1 << 62, int(rng.integers(0, 120)))))) for _ in range(80)]
    rows = [(i, i % 40, len(s), block_links.parity(s).tobytes()) for i, s in enumerate(sets)]
    assert len({len(r[3]) for r in rows}) > 1
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    all_ = {(i, j) for i, j in itertools.combinations(range(80), 2) if i % 40 != j % 40}
    got = set(block_links.undecided(rows, None, 0.8))
    assert {p for p in all_ if like(*p) >= 0.8} <= got <= all_
    assert not [p for p in got if like(*p) < 0.75]
    across = {tuple(sorted(p)) for p in block_links.undecided(rows[:50], rows[50:], 0.8)}
    assert across == {p for p in got if p[0] < 50 <= p[1]}


def test_a_frame_below_the_limit_puts_out_few_pairs(spark):
    """300 texts with a similarity of 0.755 to each other."""
    rng = np.random.default_rng(35)
    frame = rng.integers(0, 1 << 62, 246)
    rows = [(i, i, 286, block_links.parity(np.concatenate((frame, rng.integers(0, 1 << 62, 40)))).tobytes()) for i in range(300)]
    assert len(block_links.undecided(rows, None, 0.8)) < 300


def test_links_of_large_keys_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(block_links, "BLOCK_SETS", 7)
    rng = np.random.default_rng(34)
    sets = {}
    for g in range(6):
        core = np.unique(rng.integers(0, 10**6, 100))
        for k in range(15):
            sets[100 * g + k] = np.unique(np.concatenate((core[int(rng.integers(0, 12)) :], rng.integers(0, 10**6, int(rng.integers(0, 14))))))
    keys = [(g, n) for n in sets for g in {n // 100, n // 200 + 10, n % 4 + 20}]
    met = spark.createDataFrame([(k, n, n) for k, n in keys], "key long, node long, root long")
    table = spark.createDataFrame([(n, s.tolist()) for n, s in sets.items()], "node long, runs array<long>")
    links = {(r["a"], r["b"]) for r in block_links.cross_links(met, block_links.with_parities(table), lambda pairs: table, 0.8).collect()}

    def components(pairs):
        comp = {n: n for n in sets}
        for _ in sets:
            for a, b in pairs:
                comp[a] = comp[b] = min(comp[a], comp[b])
        return comp

    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    same_key = {(a, b) for k, a in keys for q, b in keys if k == q and a < b}
    assert all(near(a, b) for a, b in links)
    assert components(links) == components({p for p in same_key if near(*p)})


def test_awkward_and_empty_tables(spark):
    rows = jaccard_join.jaccard_components(awkward(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == sorted([("None", 0, "None"), ("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3"), ("4", 1, "4"), ("4", 1, "4"), ("5", 1, "4")])
    assert jaccard_join.jaccard_components(empty(spark)).collect() == []
    null_id = spark.createDataFrame([(None, "a b", None, None, None), (7, "A b", None, None, None)], DOCS).withColumn("component_id", F.lit(1))
    assert {r["component_id"] for r in jaccard_join.jaccard_components(null_id).collect()} == {7}


def test_near_dedup_keeps_one_of_each_exact_group(spark):
    """Over given documents: nothing is lost, and of the groups of all similar pairs hardly one keeps two."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in near_dup.keep_one_of_each(table).collect()}
    groups = {}
    for r in jaccard_join.jaccard_components(table).where("n_shingles > 0").collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    several = [g for g in groups.values() if len(g) > 1]
    assert len(several) > 20 and all(g & kept for g in groups.values())
    assert sum(len(g & kept) - 1 for g in groups.values()) <= 0.02 * sum(len(g) - 1 for g in groups.values())


def test_the_filter_of_keys_loses_none(spark):
    rng = np.random.default_rng(36)
    keys = [int(k) for k in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "key long, text string")
    wanted = spark.createDataFrame([(k,) for k in keys[:40]], "key long")
    kept = {r["key"] for r in fetch.likely(rows, "key", wanted).collect()}
    assert set(keys[:40]) <= kept and len(kept) < 60
    assert fetch.likely(rows, "key", wanted.limit(0)).count() == 0


def test_keys_of_the_same_nodes_are_one(spark):
    """Texts that share a passage meet in one key, however many signatures they share; no meeting is lost."""
    met = [(k, n) for k in range(40) for n in (1, 2)] + [(k, n) for k in range(40, 60) for n in (2, 3, 4)] + [(60, 1), (60, 2), (60, 3), (61, 1)]
    got = jaccard_join.shared_keys(spark.createDataFrame(met + met[:30], "key long, node long").repartition(5)).collect()
    by: dict[int, set[int]] = {}
    for r in got:
        by.setdefault(r["key"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [[1, 2], [1, 2, 3], [2, 3, 4]] and len(got) == 8
