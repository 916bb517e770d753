"""Ranked lexical search by MaxScore whose bounds join the maxima of term pairs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from limnos.storage import stage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A block of the index closes at so many documents or postings, whichever comes first.
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 250_000
#: Queries, and their terms with repeats, that one pass over the index answers; more queries take further passes.
QUERIES, QUERY_TERMS = 2000, 200_000

# doc_ids and ns by place in the block; the lists of all terms one after the other: dfs[i] places and counts each
INDEX = "doc_ids array<{id}>, ns array<bigint>, terms array<string>, dfs array<int>, places array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[str]:
    """Terms of a whole text in order, A-Z alone lower-cased."""
    return TERM.findall((text or "").translate(LOWER))


def flat(lists: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(lists).astype(kind) if lists else np.zeros(0, kind)


# --- the index ------------------------------------------------------------------


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted index of all terms of whole texts, one row a block of documents, written once.

    A block holds 2,048 documents or 250,000 postings at most (a document
    with more is alone), in the partition where its documents are: nothing is
    shuffled. It is a row group of its own, so that a task decodes one block at
    a time however many its part has. Null and empty texts, and texts without a
    term, have no postings and no place. Repeated rows each have their place; null ids stay null.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T._parse_datatype_string(INDEX.format(id=picked.schema["id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def block(ids: list, counted: list[tuple[np.ndarray, np.ndarray]], numbers: dict[str, int]) -> pa.RecordBatch:
        terms, tfs = (np.concatenate(x) for x in zip(*counted, strict=True))
        places = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t, _ in counted])
        order = np.argsort(terms, kind="stable")
        ns = np.array([tfs.sum() for _, tfs in counted], np.int64)
        made = [ids, ns, list(numbers), np.bincount(terms, minlength=len(numbers)).astype(np.int32), places[order], tfs[order]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        numbers: dict[str, int] = {}  # of the block's terms, in order of appearance
        postings = 0
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                if ids and (len(ids) == BLOCK_DOCS or postings + len(found) > BLOCK_POSTINGS):
                    yield block(ids, counted, numbers)
                    ids, counted, numbers, postings = [], [], {}, 0
                ids.append(id_)
                own = np.fromiter((numbers.setdefault(t, len(numbers)) for t in found), np.int32, len(found))
                counted.append((own, np.fromiter(found.values(), np.int32, len(found))))
                postings += len(found)
        if ids:
            yield block(ids, counted, numbers)

    return stage(picked.mapInArrow(run, schema), "search-index", group_rows=1)


# --- queries --------------------------------------------------------------------


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, id, terms) of every query, q its number; terms are distinct."""
    picked = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("terms", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(x.as_py()))) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, arrow.field("terms").type)], schema=arrow)

    return stage(picked.mapInArrow(run, schema).withColumn("q", F.monotonically_increasing_id()), "search-queries")


def query_blocks(asked: DataFrame) -> int:
    """In how many blocks the queries are answered; each fits the driver and every task."""
    total = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    return max(1, -(-total["n"] // QUERIES), -(-total["terms"] // QUERY_TERMS))


# --- bounds ---------------------------------------------------------------------


def part(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """A term's share of a score before its weight, in 64-bit integers."""
    tf = tf.astype(np.int64)
    m = 10 + (90 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def prefix_bounds(single: list[int], joint: list[int | None]) -> list[int]:
    """For each j, a bound of what the first j + 1 terms can add to any score.

    ``single`` are the terms' maxima, ``joint[j]`` the largest sum of terms j-1
    and j in one document where it is stored. Terms are matched into adjacent
    pairs so that the bound is least; a pair's joint maximum is never above the
    sum of the two, and often far below.
    """
    out: list[int] = []
    for j, most in enumerate(single):
        bound = (out[j - 1] if j else 0) + most
        if j and joint[j] is not None:
            bound = min(bound, (out[j - 2] if j > 1 else 0) + joint[j])
        out.append(bound)
    return out


PREPARED = "doc_ids array<{id}>, terms array<int>, sizes array<int>, places array<int>, impacts array<bigint>, pairs array<int>, joint array<bigint>, met array<int>, met_places array<int>, tenth array<bigint>, tenth_of array<int>"


def _prepared(index: DataFrame, numbers: dict[str, int], weights: list[int], pairs: list[tuple[int, int]], docs: int, length: int, k: int) -> DataFrame:
    """The index's lists of the queries' terms with their impacts, and the intersection list of each term pair.

    A pair's list has the places of documents with both terms, and its joint
    maximum is the largest sum of both impacts in any document of the block.
    ``tenth`` has the k-th largest impact of a term (tenth_of >= 0) or joint
    impact of a pair (tenth_of < 0) where the block has as many.
    """
    schema = T._parse_datatype_string(PREPARED.format(id=index.schema["doc_ids"].dataType.elementType.simpleString()))
    arrow = to_arrow_schema(schema)

    def prepare(batch: pa.RecordBatch, r: int) -> list:
        at = lambda name: batch.column(name)[r].values
        dfs = at("dfs").to_numpy()
        ends = np.cumsum(dfs)
        places, tfs, ns = (at(c).to_numpy() for c in ("places", "tfs", "ns"))
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, name in enumerate(at("terms").to_pylist()):
            if (t := numbers.get(name)) is not None:
                own = slice(ends[i] - dfs[i], ends[i])
                lists[t] = places[own], weights[t] * part(tfs[own], ns[places[own]], docs, length)
        tenth = [(int(np.partition(x, -k)[-k]), t) for t, (_, x) in lists.items() if len(x) >= k]
        found, joint, met = [], [], []
        most = {t: int(x.max()) for t, (_, x) in lists.items()}
        last, spread = -1, np.zeros(0, np.int64)
        for p, (a, b) in enumerate(pairs):  # by their first terms
            if a in lists and b in lists:
                if a != last:
                    last, spread = a, np.zeros(len(ns), np.int64)
                    spread[lists[a][0]] = lists[a][1]
                others = spread[lists[b][0]]
                shared = others > 0
                sums = others[shared] + lists[b][1][shared]
                found.append(p)
                joint.append(max(most[a], most[b], int(sums.max()) if len(sums) else 0))
                met.append(lists[b][0][shared])
                if len(sums) >= k:
                    tenth.append((int(np.partition(sums, -k)[-k]), -1 - p))
        known = sorted(lists)
        return [at("doc_ids").to_pylist(), known, [len(lists[t][0]) for t in known], flat([lists[t][0] for t in known], "i4"), flat([lists[t][1] for t in known], "i8"), found, joint, [len(x) for x in met], flat(met, "i4"), [x for x, _ in tenth], [t for _, t in tenth]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                made = prepare(batch, r)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return stage(index.mapInArrow(run, schema), "search-pairs", group_rows=1)


def best_of_block(lists: dict[int, tuple[np.ndarray, np.ndarray]], joint: dict[int, int], met: dict[int, np.ndarray], pair_of: dict[tuple[int, int], int], terms: list[int], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's documents that score ``least`` or more, and maybe few others.

    ``terms`` come in the order of the stored pairs. Those first terms whose
    joint bound stays below ``least`` are not essential: a document that has
    no other term is skipped unseen. Where the last of them and the one before
    form a stored pair, documents off the pair's intersection list can add the
    larger of the two at most. The others' scores are completed term by term as
    long as what is left can lift them to ``least``.
    """
    own = [t for t in terms if t in lists]
    single = [int(lists[t][1].max()) for t in own]
    stored = [pair_of.get((own[j - 1], own[j]), -1) if j else -1 for j in range(len(own))]
    bounds = prefix_bounds(single, [joint.get(p) for p in stored])
    first = next((j for j, b in enumerate(bounds) if b >= least), len(own))
    if first == len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores = np.zeros(n_docs, np.int64)
    for t in own[first:]:
        places, impacts = lists[t]
        scores[places] += impacts
    places = np.flatnonzero(scores)
    j = first - 1
    while j >= 0 and len(places):
        could = scores[places] + bounds[j]
        if j and stored[j] in met:
            apart = np.ones(n_docs, bool)
            apart[met[stored[j]]] = False
            below = bounds[j - 2] if j > 1 else 0
            could = np.where(apart[places], np.minimum(could, scores[places] + below + max(single[j], single[j - 1])), could)
        places = places[could >= least]
        at, impacts = lists[own[j]]
        where = np.minimum(np.searchsorted(at, places), len(at) - 1)
        scores[places] += np.where(at[where] == places, impacts[where], 0)
        j -= 1
    kept = scores[places] >= least
    return places[kept], scores[places[kept]]


def _searched(prepared: DataFrame, wanted: list[tuple[int, list[int], int]], pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """(q, doc, score) of each task's k best documents of every query, ties by id; ``wanted`` has (q, terms, least score)."""
    kind = prepared.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    pair_of = {p: i for i, p in enumerate(pairs)}

    def cut(sizes: np.ndarray, *values: np.ndarray) -> list[tuple]:
        ends = np.cumsum(sizes)
        return [tuple(v[e - s : e] for v in values) for s, e in zip(sizes, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        least = {q: low for q, _, low in wanted}
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].values for c in batch.schema.names}
                ids = x["doc_ids"].to_pylist()
                n = {c: x[c].to_numpy() for c in x if c != "doc_ids"}
                lists = dict(zip(n["terms"].tolist(), cut(n["sizes"], n["places"], n["impacts"]), strict=True))
                joint = dict(zip(n["pairs"].tolist(), n["joint"].tolist(), strict=True))
                met = dict(zip(n["pairs"].tolist(), (c[0] for c in cut(n["met"], n["met_places"])), strict=True))
                for q, terms, _ in wanted:
                    places, scores = best_of_block(lists, joint, met, pair_of, terms, len(ids), least[q])
                    if not len(places):
                        continue
                    order = scores >= (np.partition(scores, -k)[-k] if len(scores) > k else 0)
                    # nulls come first among equal scores, as they do in the order of the result
                    new = [(-s, ids[p] is not None, ids[p]) for p, s in zip(places[order].tolist(), scores[order].tolist(), strict=True)]
                    best[q] = sorted([*best.get(q, ()), *new], key=lambda b: b if b[1] else (b[0], False))[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], -best[q][-1][0])
        rows = [(q, b[2], -b[0]) for q, kept in best.items() for b in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return prepared.mapInArrow(run, schema)


def _answered(index: DataFrame, asked: list, docs: int, length: int, k: int) -> DataFrame:
    """(q, doc, score): candidates that hold the k best of every query of a block of queries."""
    spark = index.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["terms"]}))}
    vocabulary = spark.createDataFrame([(t,) for t in numbers], "term string")
    seen = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    # both sides of this are bounded: the vocabulary has QUERY_TERMS terms at most
    dfs = {r["term"]: r["df"] for r in seen.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = [weight(docs, dfs[t]) if t in dfs else 0 for t in numbers]
    # common terms come first: they are the ones to skip, and they are the ones whose pairs are worth storing
    ordered = {r["q"]: sorted((numbers[t] for t in r["terms"] if t in dfs and weights[numbers[t]]), key=lambda t: (weights[t], t)) for r in asked}
    pairs = sorted({p for terms in ordered.values() for p in zip(terms, terms[1:], strict=False)})
    prepared = _prepared(index, numbers, weights, pairs, docs, length, k)
    tenth = prepared.select(F.explode(F.arrays_zip("tenth_of", "tenth")).alias("x")).groupBy("x.tenth_of").agg(F.max("x.tenth").alias("tenth"))
    low = {r["tenth_of"]: r["tenth"] for r in tenth.collect()}  # a row a term or pair at most
    pair_of = {p: i for i, p in enumerate(pairs)}
    wanted = []
    for q, terms in ordered.items():
        floors = [low.get(t, 0) for t in terms] + [low.get(-1 - pair_of[p], 0) for p in zip(terms, terms[1:], strict=False)]
        wanted.append((q, terms, max([1, *floors])))
    return _searched(prepared, wanted, pairs, k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of ``index`` (index_documents) for each query.

    Scores are those of the contract of op13: sums over a query's distinct
    terms of w * ((10**9 * tf) div (1000 * tf + 8 * m)). Queries are answered in
    blocks (QUERIES, QUERY_TERMS), each in three passes over the index, which
    has no texts: frequencies of the terms; impacts of their lists with, for
    the terms that stand next to each other in a query by frequency, the pair's
    intersection list and joint maximum in each block; and the search. The k-th
    largest joint impact of a block is a score that k documents reach, so the
    search begins with the largest of these as its threshold; a task raises it
    as its k best fill up. Bounds only skip documents that stay below it, ties
    included, so results are exact. Each task puts out k documents a query at
    most, which are ranked by query at the end.

    Returns item_id, rank (from 1), doc_id and score (above 0), ties by
    ascending doc_id, null first. Every query row is a query of its own, equal
    ones too. Null and blank texts have no terms and no rows; with fewer
    documents of score above 0, all of them come. Repeated documents each have
    a rank. Empty tables give no rows; other columns are ignored.
    """
    spark = index.sparkSession
    asked = query_terms(queries, id_col, text_col)
    blocks = query_blocks(asked)
    total = index.select(F.size("ns").cast("long").alias("n"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("length")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    found = None
    for b in range(blocks):
        some = asked.where(F.size("terms") > 0)
        some = some if blocks == 1 else some.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        rows = some.select("q", "terms").collect()  # a block of queries
        if rows and total["n"]:
            answered = _answered(index, rows, total["n"], total["length"], k)
            found = answered if found is None else found.unionByName(answered)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("q", T.LongType()), T.StructField("doc", index.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())]))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc")))).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "id"), "q").select(F.col("id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


#: DuckDB SQL of the search of all documents for every benchmark item, k = 10.
SEARCH_SQL = r"""
with doc as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), total as (
  select count(*) as nn, sum(len(terms))::bigint as ll from doc where len(terms) > 0
), posting as (
  select d, doc_id, term, count(*)::bigint as tf, any_value(n)::bigint as n from (select d, doc_id, len(terms) as n, unnest(terms) as term from doc) group by d, doc_id, term
), item as (
  select distinct q, item_id, term from (
    select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
), weight as (
  select term, floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * df + 1)))::bigint as w from (select term, count(*) as df from posting group by term), total
), score as (
  select q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
  from item join weight using (term) join posting using (term), total group by q, item_id, d, doc_id
)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank from score where score > 0) where rank <= 10
"""
