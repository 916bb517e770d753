"""Ranked search against scoring every document for every query."""

import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from limnos.llm import ranked_search
from tests.llm.helpers import DOCS, LONG, awkward, docs, empty

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, k=10):
    lists = [terms(t) for t in texts]
    docs_, length = sum(map(bool, lists)), sum(map(len, lists))
    df = {}
    for x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, x in enumerate(lists):
            if x:
                m = 10 + (90 * len(x) * docs_) // length
                s = sum(math.floor(1000 * math.log((2 * docs_ + 2) / (2 * df[t] + 1))) * ((10**9 * x.count(t)) // (1000 * x.count(t) + 8 * m)) for t in set(terms(text)) if t in df)
                if s > 0:
                    scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def zipf(rng, n):
    return " ".join(f"t{min(int(x), 300)}" for x in rng.zipf(1.3, n))


@pytest.mark.parametrize("block", [7, 2048])
def test_results_are_those_of_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    rng = np.random.default_rng(block)
    texts = [zipf(rng, int(rng.integers(1, 80))) for _ in range(400)] + [None, "", "?!", "É é T1", "t1", LONG + "t5"]
    texts += texts[:40]  # ties
    items = [(i, zipf(rng, int(rng.integers(1, 25)))) for i in range(40)] + [(90, None), (91, "nowhere"), (92, "t1 T1, t1"), (93, "word t5 é")]
    index = ranked_search.index_documents(docs(spark, *texts).repartition(5, "doc_id"))
    got = ranked_search.search(index, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got)) == brute(texts, items)


def test_a_task_decodes_one_block_at_a_time(spark, monkeypatch):
    """Readers decode up to 4,096 rows of a row group at once, and a block's row has megabytes."""
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 7)
    texts = [zipf(np.random.default_rng(d), 20) for d in range(50)]
    index = ranked_search.index_documents(docs(spark, *texts).coalesce(1))
    prepared = ranked_search._prepared(index, {"t1": 0, "t2": 1}, [3, 4], [(0, 1)], 50, 1000, 10)
    for table in (index, prepared):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
        assert table.count() == 8
        assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1] * 8


def test_queries_are_answered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERIES", 6)
    rng = np.random.default_rng(8)
    texts = [zipf(rng, 30) for _ in range(100)]
    items = [(i, zipf(rng, 9)) for i in range(20)]
    got = ranked_search.search(ranked_search.index_documents(docs(spark, *texts)), spark.createDataFrame(items, ITEMS), k=3).collect()
    assert sorted(map(tuple, got)) == brute(texts, items, 3)


def test_documents_below_the_bounds_are_skipped():
    """Pairs that never meet in a document bound each other: fewer terms are essential than by their own maxima."""
    single, joint = [50, 60, 70, 80], [None, 62, None, 85]
    assert ranked_search.prefix_bounds(single, [None] * 4) == [50, 110, 180, 260]
    assert ranked_search.prefix_bounds(single, joint) == [50, 62, 132, 147]
    lists = {t: (np.array([t]), np.array([single[t]])) for t in range(4)}
    pair_of = {(0, 1): 0, (2, 3): 1}
    met = {0: np.zeros(0, int), 1: np.zeros(0, int)}
    places, scores = ranked_search.best_of_block(lists, {0: 62, 1: 85}, met, pair_of, [0, 1, 2, 3], 4, 148)
    assert len(places) == 0
    places, scores = ranked_search.best_of_block(lists, {0: 62, 1: 85}, met, pair_of, [0, 1, 2, 3], 4, 70)
    assert dict(zip(places.tolist(), scores.tolist(), strict=True)) == {2: 70, 3: 80}


def test_awkward_and_empty_tables(spark):
    queries = spark.createDataFrame([(None, "ONE"), (None, None), (2, "two"), (2, "two")], ITEMS).withColumn("rank", F.lit("x")).withColumn("q", F.lit(1))
    got = ranked_search.search(ranked_search.index_documents(awkward(spark)), queries).collect()
    assert sorted((str(r["item_id"]), r["rank"], r["doc_id"]) for r in got) == sorted([("None", 1, 4), ("None", 2, 4), ("None", 3, 5)] + [("2", 1, 4), ("2", 2, 4), ("2", 3, 5)] * 2)
    assert ranked_search.search(ranked_search.index_documents(empty(spark)), queries).collect() == []
    assert ranked_search.search(ranked_search.index_documents(awkward(spark)), spark.createDataFrame([], ITEMS)).collect() == []
    null_ids = spark.createDataFrame([(None, "a b", None, None, None), (3, "a b", None, None, None), (None, "b", None, None, None)], DOCS)
    got = ranked_search.search(ranked_search.index_documents(null_ids), spark.createDataFrame([(1, "a")], ITEMS), k=1).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, None)]
