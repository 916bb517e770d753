"""Training-data operators: brute force, round trips and awkward tables."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from limnos.llm import chat, decontaminate, html_extract, media, mixing, near_dup, quality, secrets, token_counts, url_filter
from limnos.operators import skew
from limnos.operators.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000


def docs(spark, *texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, clashing column names."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n ", "en", None, 4), (3, LONG, "en", "a", len(LONG)), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, "ONE two", None, "b", 7)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("node", "score", "size", "row", "owner", "start", "fp", "hash", "key", "copies", "found", "host", "_text_key", "text_key", "leak_id", "leak_key", "row_id", "row_text", "spans", "live", "k0", "scanned_text"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- components and near duplicates ---------------------------------------------------


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert {x: got.get(x, x) for x in nodes} == {x: find(x) for x in nodes}


def test_salted_joins_are_plain_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 5)
    rows = [(0, i) for i in range(500)] + [(k, k) for k in range(1, 40)] + [(7, 1)] * 30 + [(None, 2), (99, 3), (99, 3)]
    many = spark.createDataFrame(rows, "k int, salt int")
    few = spark.createDataFrame([(k, f"v{k}") for k in (0, 3, 7, 8, 1000)], "k int, hot string")
    for how in ("inner", "left"):
        plain = many.join(few, "k", how)
        salted = skew.salted_join(many, few, "k", how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_components_of_a_star_and_chains_on_it(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 5)
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(299, 320)] + [(400, i) for i in range(1, 300, 3)] + [(500, 501), (501, 501), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1, 321), 400]} | {501: 500}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(n)) for n in (40, 90, 200, 3, 2, 400)]
    texts = [*base, base[2] + " end", base[5].replace("w1 ", "w2 ", 1), base[5].upper(), None, "", "É é", base[1], LONG]
    texts += [" ".join([*base[5].split()[:k], "x", *base[5].split()[k:]]) for k in range(0, 400, 40)]
    got = near_dup.simhash_components(docs(spark, *texts)).collect()
    fp = [brute_fingerprint(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fp, comp, strict=True))]


def test_thresholds_are_the_cheapest():
    costs = [[0, 5, 9], [0, 1, 50], [0, 2, 3]]
    import itertools

    want = min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in itertools.product((-1, 0, 1), repeat=3) if sum(ts) == 0)
    cost, chosen = near_dup.allocate(costs, 0)
    assert cost == want and sum(chosen) == 0


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(0, 3000)}" for _ in range(300)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    near = [" ".join([*b[:150], "changed", *b[151:]]) for b in base[:6]]
    kept = {r["doc_id"] for r in near_dup.keep_one_of_each(docs(spark, *texts, *near, texts[7], texts[8].upper())).collect()}
    assert kept == set(range(12))


def similarity_of(a, b):
    x, y = (set(near_dup.shingles(near_dup.words_of(t), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def fresh(rng, n):
    return [f"w{rng.integers(0, 100_000)}" for _ in range(n)]


def test_near_copies_with_more_or_less_text_are_found(spark):
    rng = np.random.default_rng(12)
    base, near = [], []
    for k in range(60):
        n = 150 + 5 * k
        b, more = fresh(rng, n), fresh(rng, n // 8)
        base.append(" ".join(b))
        near.append(" ".join([[*b, *more], b[: n - n // 8], [*b[: n // 2], *more, *b[n // 2 :]], [*more, *b]][k % 4]))
    assert all(0.83 <= similarity_of(a, b) <= 0.9 for a, b in zip(base, near, strict=True))
    kept = {r["doc_id"] for r in near_dup.keep_one_of_each(docs(spark, *base, *near)).collect()}
    assert kept == set(range(60))


def test_the_limit_of_near_copies_is_exact(spark):
    rng = np.random.default_rng(13)
    base, near = [], []
    for k in range(60):
        b = fresh(rng, 300)
        base.append(" ".join(b))
        near.append(" ".join([*b, *fresh(rng, 74 if k < 30 else 75)]))  # 296 of 370 or 371 shingles in common
    alike = [similarity_of(a, b) >= 0.8 for a, b in zip(base, near, strict=True)]
    assert alike == [True] * 30 + [False] * 30
    kept = {r["doc_id"] for r in near_dup.keep_one_of_each(docs(spark, *base, *near)).collect()}
    assert kept == set(range(60)) | set(range(90, 120))


# --- decontamination ---------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = np.random.default_rng(3)
    item = " ".join(f"q{rng.integers(0, 500)}" for _ in range(40))
    other = " ".join(f"z{rng.integers(0, 500)}" for _ in range(25))
    filler = " ".join(f"f{rng.integers(0, 500)}" for _ in range(120))
    edited = item.split()
    edited[1] = "edit"  # 34 of 38 shingles in common
    far = item.split()
    far[3::6] = ["far"] * len(far[3::6])
    texts = [filler, f"{filler} {item.upper()} {filler}", item, f"{filler} {' '.join(edited)}", f"{filler} {' '.join(far)} {filler}", f"{item[:-1]}", None, "", other + " tail", "short"]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, *texts), bench, {"doc_id": F.col("doc_id")}, F.col("text")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (8, 2)}
    left = {r["doc_id"] for r in decontaminate.remove_leaks(docs(spark, *texts), bench).collect()}
    assert left == {0, 4, 6, 7, 9}


def test_native_simhash_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    lists = [[int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)] for n in (1, 2, 7, 300)]
    df = spark.createDataFrame([(x,) for x in lists], "h array<long>").select("h", decontaminate.simhash(F.col("h")).alias("fp"))
    for r in df.collect():
        h = [x & (1 << 64) - 1 for x in r["h"]]
        assert r["fp"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_bags_of_very_many_shingles(spark):
    many = spark.range(1).select(F.array_repeat(F.lit(5).cast("long"), 70_000).alias("h"))
    r = many.select(decontaminate.simhash(F.col("h")).alias("fp"), F.size(F.array_distinct(decontaminate.numbered(F.col("h")))).alias("n")).first()
    assert (r["fp"], r["n"]) == (5, 70_000)
    a, b = (spark.createDataFrame([(x,)], "h array<long>").select(decontaminate.numbered(F.col("h")).alias("x")).first()["x"] for x in ([7, 7, 3, 7, 3], [3, 7, 7]))
    assert len(set(a)) == 5 and len(set(b)) == 3 and set(b) < set(a)


def test_items_are_broadcast_in_bounded_blocks(spark):
    short = spark.range(1_000_000).select(F.lit(1).alias("m"))
    assert decontaminate.blocks_of(short) == 100
    assert decontaminate.blocks_of(spark.createDataFrame([(2_500_000,)], "m int")) == 3
    assert decontaminate.blocks_of(short.limit(0)) == 1


def test_windows_near_the_limit_are_found(spark):
    """Every pair at a similarity of 0.80 to 0.85 that brute force over all windows finds."""
    rng = np.random.default_rng(21)
    items, texts = [], []
    for k in range(60):
        item = [f"i{rng.integers(0, 10**6)}" for _ in range(80)]
        items.append((k, " ".join(item)))
        edited = [*item[:40], "new", *item[41:]] if k % 2 else item[: 80 - 7]  # 71 of 81, or 69 of 76 with more words after it
        texts.append(" ".join([f"t{rng.integers(0, 10**6)}" for _ in range(30)] + edited + [f"t{rng.integers(0, 10**6)}" for _ in range(30)]))

    def best(text, item):
        a, b = (near_dup.shingles(near_dup.words_of(t), 5) for t in (text, item))
        return max(len(set(a[i : i + len(b)]) & set(b)) / len(set(a[i : i + len(b)]) | set(b)) for i in range(max(1, len(a) - len(b) + 1)))

    want = {k for k in range(60) if best(texts[k], items[k][1]) >= 0.8}
    found = decontaminate.find_leaks(docs(spark, *texts), spark.createDataFrame(items, "item_id long, text string"), {"doc_id": F.col("doc_id")}, F.col("text")).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in want}


# --- chat ---------------------------------------------------------------------------------


def test_calls_are_linked_checked_and_ordered(spark):
    schemas = {"add": (("x", "integer", True), ("note", "string", False))}
    calls = spark.createDataFrame(
        [(1, "c", "add", '{"note": "n", "x": 1}', ["b"]), (1, "b", "add", '{"x": "1"}', ["a"]), (1, "a", "add", "{}", []), (1, "d", "nope", "{}", ["zzz"]), (2, "e", "add", "{", None), (2, "f", "add", '{"x":2}', ["g"]), (2, "g", "add", '{"x":2}', ["f"]), (2, None, "add", "{}", [])],
        "conv_id int, call_id string, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([("c", "ok"), ("c", "ok"), ("x", "lost"), (None, "n")], "call_id string, content string")
    got = {r["call_id"]: r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": None, "g": None}
    assert {k: r["status"] for k, r in got.items()} == {"a": "invalid", "b": "invalid", "c": "linked", "d": "invalid", "e": "invalid", "f": "cyclic", "g": "cyclic"}
    assert got["b"]["faults"] == "x is no integer" and got["a"]["faults"] == "x is missing" and got["e"]["faults"] == "no JSON"
    assert got["c"]["message"] == '{"arguments":{"note":"n","x":1},"id":"c","result":"ok","tool":"add"}'


def test_long_chains_and_cycles_are_followed_by_doubling(spark):
    calls = [(1, f"c{i:04d}", "t", "{}", [f"c{i - 1:04d}"] if i else []) for i in range(300)] + [(1, "x", "t", "{}", ["y"]), (1, "y", "t", "{}", ["x"]), (1, "z", "t", "{}", ["y"])]
    got = {r["call_id"]: r["level"] for r in chat.ranked(spark.createDataFrame(calls, "conv_id int, call_id string, tool string, arguments string, after array<string>")).collect()}
    assert all(got[f"c{i:04d}"] == i for i in range(300)) and got["x"] is got["y"] is got["z"] is None


def test_calls_with_several_predecessors(spark):
    """Levels against a search by hand, in a random order of calls with cycles."""
    rng = np.random.default_rng(22)
    after = {k: sorted({int(x) for x in rng.integers(0, k, rng.integers(0, 4))}) if k else [] for k in range(120)}
    after |= {120: [121, 3], 121: [120], 122: [121, 5], 123: [122]}
    level = {}
    for k in range(120):
        level[k] = 1 + max((level[x] for x in after[k]), default=-1)
    rows = [(1, f"c{k}", [f"c{x}" for x in v]) for k, v in after.items()]
    got = {r["call_id"]: r["level"] for r in chat.ranked(spark.createDataFrame(rows, "conv_id int, call_id string, after array<string>")).collect()}
    assert got == {f"c{k}": level.get(k) for k in after}


def test_turns_of_any_size_stay_apart(spark):
    turns = [(1, t, r, f"{r} {t}") for t, r in ((123456, "user"), (123457, "assistant"), (1234567, "user"), (1234568, "assistant"), (-4, "user"), (-3, "assistant"), (-2, "user"), (0, "user"))]
    got = {r["call_id"]: r for r in chat.link_tool_calls(*chat.turns_as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: json.loads(r["message"]).get("result") for k, r in got.items()} == {"1:123456": "assistant 123457", "1:1234567": "assistant 1234568", "1:-4": "assistant -3", "1:-2": None, "1:0": None}
    assert {r["level"] for r in got.values()} == {0}


# --- media --------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = ["a" * 63, "b" * 64, "é" * 65, "", None, LONG, "a" * 63]
    got = {r["doc_id"]: r for r in media.media_features(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode_png(media.encode_png(payload, len(raw))) == (len(raw), payload)
        json.loads(got[i]["feature"])
    assert got[0]["media_sha256"] == got[6]["media_sha256"]


def test_damaged_members_are_tried_again_and_named(spark, tmp_path):
    from limnos.storage import new_path

    listed = media.write_archives(docs(spark, "abc", "def"), new_path(spark, "m"))
    archive = listed.first()["archive"]
    path = archive.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[80] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, listed, tries=2).collect()


def test_ranges_are_packed_into_bounded_tasks(spark):
    from limnos.storage import new_path

    texts = [f"text {k} " * k for k in range(60)]
    listed = media.write_archives(docs(spark, *texts).repartition(4, "doc_id"), new_path(spark, "m"))
    want = sorted((str(k), media.payload_of(t)[1]) for k, t in enumerate(texts))
    whole = sum(r["bytes"] for r in listed.collect())
    for options in ({}, {"range_bytes": 500}, {"range_bytes": 500, "most_tasks": 3}, {"range_bytes": whole * 2}):
        read = media.read_archives(spark, listed, **options)
        assert sorted((r["id"], media.decode_png(r["media"])[1]) for r in read.collect()) == want
        tasks = media.MediaReader({"list": listed.inputFiles()[0].rsplit("/", 1)[0], **{k: str(v) for k, v in options.items()}}).partitions()
        assert len(tasks) <= int(options.get("most_tasks", 10**6)) and (options.get("range_bytes") != 500 or len(tasks) > 1)


# --- urls ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://x.org", "x.org", "", None),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/"),
        ("http://x.com?a/fr/", "x.com", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string").withColumn("host", url_filter.host(F.col("url"))).withColumn("path", url_filter.path(F.col("url")))
    r = df.withColumn("rule", url_filter.matched_rule(F.col("host"), F.col("path"))).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)


def test_trees_learn_what_rules_tell(spark):
    rng = np.random.default_rng(5)
    urls = [f"http://shop{rng.integers(0, 99)}.com/de/p{rng.integers(0, 9999)}?id={rng.integers(0, 9999)}&k=1" for _ in range(150)] + [f"http://news{rng.integers(0, 99)}.org/a" for _ in range(150)]
    rest = [f"http://shop{i}.net/de/p{i * 97}?id={i * 31}&k=1" for i in range(20)] + [f"http://news{i}.net/a" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls + rest)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, trees=5).collect()}
    assert len(got) == 340
    assert sum(got[300 + i] == "block" for i in range(20)) >= 16 and sum(got[320 + i] == "allow" for i in range(20)) >= 16
    none = spark.createDataFrame([(1, None), (2, "x")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge_urls(none).collect()} == {"allow"}


def labelled_urls(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", url_filter.host(F.col("url"))).withColumn("path", url_filter.path(F.col("url")))
    return df.withColumn("label", F.col("path").startswith("/de/").cast("double"))


def test_trees_rank_urls_of_hosts_they_never_saw(spark):
    rng = np.random.default_rng(23)
    kinds = ("/de/p{}?id={}&k=1", "/a/{}x{}")
    urls = [f"http://w{h}.com" + kinds[h % 2].format(rng.integers(0, 9999), rng.integers(0, 9999)) for h in range(120) for _ in range(4)]
    all_ = labelled_urls(spark, urls)
    seen, held = all_.where(url_filter.fold(F.col("host")) > 0), all_.where(url_filter.fold(F.col("host")) == 0)
    scored = url_filter.score_trees(held.select("url", "host", "path", "label"), url_filter.fit_trees(seen.select("url", "host", "path", "label"), trees=5)).collect()
    pos, neg = ([r["score"] for r in scored if r["label"] == k] for k in (1.0, 0.0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 20 and len(neg) > 20 and auc >= 0.9


def test_trees_rank_given_urls_of_hosts_they_never_saw(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct()
    urls = pages.withColumn("host", url_filter.host(F.col("url"))).withColumn("path", url_filter.path(F.col("url")))
    blocked = [k for k, v in url_filter.RULES if v == "block"]
    rule = url_filter.matched_rule(F.col("host"), F.col("path"))
    all_ = urls.withColumn("rule", rule).where("rule is not null").select("url", "host", "path", F.col("rule").isin(blocked).cast("double").alias("label"))
    seen, held = all_.where(url_filter.fold(F.col("host")) != 0), all_.where(url_filter.fold(F.col("host")) == 0)
    scored = url_filter.score_trees(held, url_filter.fit_trees(seen)).collect()
    pos, neg = (np.array([r["score"] for r in scored if r["label"] == k]) for k in (1.0, 0.0))
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert min(len(pos), len(neg)) > 20 and auc >= 0.95


def test_one_url_repeated_decides_nothing_else(spark):
    urls = [f"http://a{k}.org/x{k}" for k in range(60)] + [f"http://shop{k}.com/de/p{k}?id={k}&k=1" for k in range(60)]
    rest = ["http://calm.net/x5", "http://shop.net/de/p9?id=7&k=1"]
    once = spark.createDataFrame(list(enumerate(rest + urls)), "page_id long, url string")
    often = spark.createDataFrame(list(enumerate(rest + urls + [urls[-1]] * 300)), "page_id long, url string")
    a, b = ({r["page_id"]: (r["verdict"], r["score"]) for r in url_filter.judge_urls(df, rows=50, trees=5).collect()} for df in (once, often))
    assert all(a[k] == b[k] for k in a) and (a[0][0], a[1][0]) == ("allow", "block")


def test_rules_match_their_sql(spark):
    import duckdb

    hosts = ["org", "example.org", "x.example.org", "EXAMPLE.org", "a.com", "com", "com.net", "notexample.org", "b.net", ""]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?x", "/en/2", "/fr/", "/FR/", "/de/x#y", "/de", "?/fr/", "#/de/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "x", "mailto:a", "http:/a", "a://b://c/de/"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), trees=2).collect()}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    for page_id, host, path, rule, ruled in con.execute(url_filter.RULES_SQL).fetchall():
        assert got[page_id][:3] == (host, path, rule) and (ruled is None or got[page_id][3] == ruled), urls[page_id]


# --- quality ------------------------------------------------------------------------------


def test_quality_is_learned_and_held_out(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["river", "stone", "green", "walks", "under"], 30)) for _ in range(150)]
    bad = [" ".join(x + "%%%" for x in rng.choice(["river", "stone", "green"], 30)) for _ in range(150)]
    df = docs(spark, *good, *bad, None, "")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (301, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify_quality(df.withColumn("score", F.lit("x")), labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == (i < 150) for i in held) >= 0.95 * len(held)


def test_documents_repeated_under_one_id_weigh_as_one(spark):
    rows = [(7, f"text {k}", "en", "s", 6) for k in range(300)] + [(k, "other words", "en", "s", 11) for k in range(20, 30)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(7, 1, 0)] + [(k, 0, 0) for k in range(20, 30)], "doc_id long, quality int, toxic int")
    one = df.where("doc_id <> 7 or text = 'text 0'")
    assert quality.fit_quality(df, labels) == quality.fit_quality(one, labels)


def test_features_of_pieces_match_the_whole(monkeypatch):
    """Wherever the pieces end: in words, at blanks, in runs of blanks, in words longer than a piece."""
    rng = np.random.default_rng(6)
    texts = ["word " * 30 + "end", "x" * 333 + " " + "é" * 120 + "\t\n  a a a", "", "   ", "a", "ab " * 77 + "  " + "b" * 49 + " " + "c" * 50 + "  c"]
    texts += ["".join(rng.choice(list("ab \n"), 400)) for _ in range(20)]
    count = lambda text: np.unique(np.concatenate([*quality.features(text), np.zeros(0, np.int32)]), return_counts=True)
    whole = [count(t) for t in texts]
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(quality, "PIECE", piece)
        for (ids, n), t in zip(whole, texts, strict=True):
            got = count(t)
            assert got[0].tolist() == ids.tolist() and got[1].tolist() == n.tolist(), (piece, t)


# --- tokens -------------------------------------------------------------------------------


def test_edits_match_encoding_anew():
    import random

    random.seed(5)
    parts = ["a", "bc", "'", "l", "s", "  ", "\n", " ", "1", "23", "é", "!", "..", "re", "ve"]
    for _ in range(300):
        tree = token_counts.TokenTree("".join(random.choice(parts) for _ in range(random.choice([0, 3, 20, 900]))))
        for _ in range(3):
            a = random.randint(0, len(tree.text))
            b = random.randint(a, min(len(tree.text), a + random.choice([0, 1, 5, 300])))
            tree.edit(a, b, "".join(random.choice(parts) for _ in range(random.choice([0, 1, 4, 200]))))
            anew = token_counts.TokenTree(tree.text)
            assert sum(map(len, tree.texts)) == tree.sums[1, 0]
            assert tree.tokens == anew.tokens == len(tree.count.encode(tree.text))
            assert [s for sizes, _ in tree.leaves for s in sizes] == [s for sizes, _ in anew.leaves for s in sizes]


def test_edits_of_a_long_text_cost_what_they_touch():
    import time

    text = "call 1234567890 and more words " * 60_000
    tree, begun = token_counts.TokenTree(text), time.time()
    for k in reversed(range(0, 60_000, 2)):
        tree.edit(31 * k + 5, 31 * k + 15, "[MASKED]")
    assert time.time() - begun < 30
    assert tree.text == ("call [MASKED] and more words call 1234567890 and more words " * 30_000)
    assert tree.tokens == token_counts.TokenTree(tree.text).tokens
    tree.edit(0, len(tree.text), "")
    assert tree.tokens == 0 and tree.text == "" and len(tree.leaves) == 1


# --- mixing -------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == 4000 and (got["taken"] <= 2 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert ((per["taken"] - per["target"]).abs() <= 9).all() and (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()


# --- html ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; more</h1><p>First <b>line\n x</b><br>next<p>Second</article><footer>f</footer>", "Head & more First line x next Second"),
        ("<article><p>Kept</p><div class='comments'><p>Reader says</p></div><aside>side</aside><form>in</form><p>End</p></article>", "Kept End"),
        ("<div class=ad>Buy</div><div>" + "plain words " * 20 + "</div><div class='sidebar'>s</div>", ("plain words " * 20).strip()),
        ("", ""),
        (None, ""),
        ("<script>only", ""),
        ("<article><!-- c --><p title=\"a>b\">x</p></article>", "x"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page or "") == text


TEXT = "Words of an article that go on for a while, so that there is some text to keep. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='content no-sidebar'><h1>Title</h1><p>{}</p><p>The end.</div>",
        "<body><ul><li class='nav'>Home<li class='nav'>About</ul><div><h1>Title</h1><p>{}<p>The end.</div>",
        "<body><p class='notice'>We use cookies<div><h1>Title</h1><p>{}<p>The end.</div>",
        "<body><div class='layout with-sidebar'><h1>Title</h1><p>{}<p>The end.</div><div class='sidebar'>side</div>",
        "<article><div class='entry-header'><h1>Title</h1></div><p>{}</p><div class='share'><a href='/'>Share</a></div><p>The end.</article>",
        "<div><p>Buy this.</div><div><h1>Title</h1><p>{}</p><p>The end.</p></div><div class='comments'><p>{}{}</div><div>small print</div>",
        "<table><tr><td class='menu'>Home<td><h1>Title</h1><p>{}<p>The end.</table>",
    ],
)
def test_articles_survive_what_stands_around_them(page):
    assert html_extract.main_text(page.replace("{}", TEXT)) == f"Title {TEXT}The end."


LONG_BLOCK = ("Words of an article that go on for a while, so that there is some text to keep. " * 4).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><section><p>Short intro.</p></section><section><p>{}</p></section></article>", "Short intro. {}"),
        ("<article><section><h2>Main</h2><p>{}</p></section><section><p>The end of it.</p></section></article>", "Main {} The end of it."),
        ("<article><div><p>Dr. Who writes.</p></div><div><p>{}</p></div><div><p>Bye.</p></div></article>", "Dr. Who writes. {} Bye."),
        ("<article><p>In.</p><table><tr><th>Year</th><th>Value</th></tr><tr><td>1999</td><td>12</td></tr></table><p>{}</p><p>End.</p></article>", "In. Year Value 1999 12 {} End."),
        ("<body><div><table><caption>Rain</caption><tr><td>1999<td>12</table><p>{}</p><p>End.</p></div></body>", "Rain 1999 12 {} End."),
        ("<article><p>So <span class='share-price'>the price</span> is <b class=ad>up</b>.</p><div class='ad-hoc'>Adhoc</div><section class='related-work'>Rel</section><p>{}</p><div class='lunch-menu'>Lunch</div></article>", "So the price is up. Adhoc Rel {} Lunch"),
        ("<div>Buy!</div><article><p>{}</p></article><section><p>a reader</p><p>{}</p></section><div>Buy!</div>", "{}"),
        ("<article><p>{}</p><section><h3>3 Comments</h3><p>{}</p></section><div><p>Advertisement</p><p>Buy</p></div><p>End.</p></article>", "{} End."),
        ("<article><p>{}</p><article><p>{}{}</p></article><div class='cookie-banner'>c</div><div class='comment-list'>d</div><p>End.</p></article>", "{} End."),
        ("<main><h1>Top</h1><div>by me</div><article><p>{}</p></article></main><footer>f</footer>", "Top by me {}"),
        ("<h1>Top</h1><article><div><div><p>{}</p></div></div><div>1</div></article>", "Top {} 1"),
        ("<div>menu</div><div><div><p>{}</p></div><div>between</div><div><p>{}</p></div></div><div>foot</div>", "{} between {}"),
    ],
)
def test_whole_articles_stay(page, text):
    """Short sections, tables, first and last blocks; comments and adverts without names go."""
    assert html_extract.main_text(page.replace("{}", LONG_BLOCK)) == text.replace("{}", LONG_BLOCK)


def test_surge_and_dive_alone_find_the_articles(spark):
    """Without article, main and class names, and against sums over windows taken by hand."""
    import html

    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br)\b[^>]*>", "\0", inner)).split("\0")
        return " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    def brute(page):
        page = re.sub(r"<(script|style|title|nav|footer)\b.*?</\1>", "", re.sub(r"<!.*?>", "", page), flags=re.S)
        page = re.sub(r"\s+", " ", page)
        page = re.sub(r"</?(div|body|html)\b[^>]*>", "\n\0\n", page)  # a line of its own, which is empty
        page = re.sub(r"</?(h1|p|br|head|meta)\b[^>]*>", "\n", page.replace("<h1>", "\n<h1>\1"))
        rows = [x for x in (re.sub(r"<[^>]*>", "", y).strip() for y in page.split("\n")) if x]
        weights = [0 if x == "\0" else len(html.unescape(x.lstrip("\1"))) + 200 * x.startswith("\1") for x in rows]
        sums = [weights[i] + (weights[i - 1] if i else 0) for i in range(len(rows))]
        runs = [[]]
        for i in range(len(rows)):
            if sums[i] == 0:
                runs.append([])
            elif weights[i]:
                runs[-1].append(i)
        peak = lambda run: max(sums[i] if i - 1 in run or weights[i - 1] == 0 else weights[i] for i in run)
        runs = [r for r in runs if r]
        least = min(150, max(map(peak, runs)) / 2)
        return " ".join(" ".join(html.unescape(rows[i].lstrip("\1")).split()) for r in runs if peak(r) >= least for i in r)

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        plain = page.replace("article>", "div>").replace('<div class="ad">', "<div>")
        assert html_extract.main_text(plain, hints=False) == brute(plain) == article(page) == html_extract.main_text(page)


def test_odd_markup_takes_time_in_proportion():
    import time

    begun = time.time()
    for page in ("<div>" * 30_000 + "</section>" * 30_000, "<ul><li>" * 20_000 + "x", "<div class=nav><h1>x</h1>" * 20_000, "<article><div>x" * 20_000, "<main>" * 20_000 + "<p>x" * 20_000, "<" * 50_000, "<a href='" * 5_000):
        html_extract.main_text(page)
    assert time.time() - begun < 20


# --- secrets ------------------------------------------------------------------------------


def brute_spans(text):
    pats = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    out = []
    for k, (name, p) in enumerate(pats):
        for m in re.finditer(p, text):
            if (name == "assign" and len(m[2]) >= 6) or (name == "access" and len(m[0]) >= 20) or (name == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_match_brute_force(spark):
    texts = ["é token=abc123 PassWord : 'longer.value-1' api_key=short", "AKIA" + "A" * 16 + " AKIAB " + "0" * 24 + " " + "f" * 23, "secret=token: abcdefgh", "", None, LONG + " passwd=zzzzzz", "x" * 50 + "apikey==abcdef"]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i]["spans"] == want and got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_ownership_separates_examples_from_live_keys(spark):
    example, own = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2"
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, f"a {example}", f"b {example}", f"c {example}", f"d {own}")).collect()}
    assert [got[i]["spans"] for i in range(4)] == ["", "", "", "owned:2:26"]
    clean = [r["text"] for r in secrets.redact_secrets(docs(spark, f"é {own} token=abcdefg é", None)).orderBy("doc_id").collect()]
    assert clean == ["é [SECRET] [SECRET] é", None]


def test_owners_and_repositories_may_disagree(spark):
    """One owner's key in four repositories is copied about; one in two of one owner's is its own."""
    spread, own = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2"
    rows = [(k, f"k {spread}", f"l{k}", "s", 0) for k in range(4)] + [(10 + k, f"k {own}", f"l{k}", "s", 0) for k in range(2)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[k]["spans"] for k in (0, 3, 10, 11)] == ["", "", "owned:2:26", "owned:2:26"]
    assert got[0]["frequency"] == "owned:2:26:1:4" and got[10]["frequency"] == "owned:2:26:1:2"


def test_frequencies_and_owned_values_match_brute_force(spark):
    """Counts of owners and repositories of every candidate, and what is owned, over a given table with copies and keys added."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keys = ["Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2", "deadbeef0123456789abcdef"]
    added = [(10_000 + i, f"x {keys[i % 3]} token={keys[(i + 1) % 3]} y" + (" Qw1Er2Ty3Ui4Op5As6Df7Gh8 api_key: Hg8Fd7Sa6Po5Iu4Yt3Re2Wq1" if i < 6 else ""), f"l{i % 2}", f"s{i % (1 + i // 8)}", 0) for i in range(24)]
    df = table.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(added, DOCS))
    rows, places = df.collect(), {}
    for r in rows:
        for *_, v in secrets.candidates(r["text"] or ""):
            places.setdefault(v, set()).add((r["source"] or "", (r["source"] or "", r["lang"] or "")))
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    n_owned = 0
    for r in rows:
        found = secrets.candidates(r["text"] or "")
        want, told = set(), []
        for kind, s, e, vs, ve, v in found:
            owners, repos = ({p[k] for p in places[v]} for k in (0, 1))
            told.append((s, kind, f"{secrets.KINDS[kind]}:{s}:{e}:{len(owners)}:{len(repos)}"))
            if kind < 3:
                want.add((s, kind, f"{secrets.KINDS[kind]}:{s}:{e}"))
            if secrets.looks_live(v) and len(owners) == 1 and len(repos) <= 3:
                want.add((vs, 3, f"owned:{vs}:{ve}"))
        n_owned += sum(k == 3 for _, k, _ in want)
        assert got[r["doc_id"]]["spans"] == ",".join(x[2] for x in sorted(want))
        assert got[r["doc_id"]]["frequency"] == ",".join(x[2] for x in sorted(told))
    assert n_owned > 10


# --- awkward tables -----------------------------------------------------------------------


def run_all(df, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two"), (None, None)], "item_id long, text string")
    return {
        "leaks": decontaminate.find_leaks(df, bench, {"doc_id": F.col("doc_id")}, F.col("text")),
        "left": decontaminate.remove_leaks(df, bench),
        "media": media.media_features(df),
        "urls": url_filter.judge_urls(df.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text"))),
        "quality": quality.classify_quality(df, labels),
        "simhash": near_dup.simhash_components(df),
        "kept": near_dup.keep_one_of_each(df),
        "tokens": token_counts.count_tokens(df),
        "mix": mixing.mix_sources(df),
        "html": html_extract.extract_html(df.withColumn("page_id", F.col("doc_id")).withColumn("html", F.col("text")).withColumn("url", F.col("text"))),
        "secrets": secrets.scan_secrets(df),
        "redacted": secrets.redact_secrets(df),
        "chat": chat.link_tool_calls(*chat.turns_as_calls(df.withColumns({"conv_id": F.col("doc_id"), "turn": F.col("n_chars"), "role": F.lit("user")}))),
        "whole mix": mixing.mix_sources(df, whole_rows=True),
    }


def test_awkward_rows_have_results(spark):
    df = awkward(spark)
    out = {k: v.collect() for k, v in run_all(df, spark).items()}
    for k in ("media", "urls", "quality", "simhash", "tokens", "mix", "html", "secrets", "redacted", "whole mix"):
        assert len(out[k]) == 7, k
    assert {r["doc_id"] for r in out["leaks"]} == {4, 5} and len(out["left"]) == 4
    assert sorted(str(r["doc_id"]) for r in out["kept"]) == ["1", "3", "4"]
    assert sorted(r["call_id"] for r in out["chat"]) == ["1:0", f"3:{len(LONG)}", "4:7", "5:7", "2:4"][:1] + ["2:4", f"3:{len(LONG)}", "4:7", "5:7"]
    assert {"size", "_size", "copies", "_copies"} <= set(out["whole mix"][0].asDict()) and out["whole mix"][0]["size"] == "x"


def test_empty_tables_give_no_rows(spark):
    for k, v in run_all(empty(spark), spark).items():
        assert v.count() == 0, k
