"""Similarity join of word n-gram sets by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from limnos.llm.block_links import cross_links, parity, sifted_pairs, similar
from limnos.operators.graph import components
from limnos.llm.fetch import likely
from limnos.llm.near_dup import LOWER, WORD, fingerprint_rows
from limnos.storage import scope, stage

#: Up to this distance each part is cut in three, two of which make a signature; beyond it in two, of which one does.
THREES = 64
#: Domains are partitioned anew for sets that leave too many parts empty; after so many times they meet in one key.
SALTS = 16
U64 = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-mixed 64-bit values of others."""
    x = (x + U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class Hashes(dict):
    """Hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def set_of(text: str | None, size: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a whole text's runs of so many words; of all its words where they are fewer."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    h = np.fromiter(map(_hashes.__getitem__, words), "<u8", n)
    width = min(size, n)
    out = np.full(n - width + 1, width, "<u8")
    for k in range(width):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[k : n - width + 1 + k]
    return np.unique(mixed(out))


# --- signatures -------------------------------------------------------------------


class Bands:
    """Size bands of sets for a limit of similarity ``num / den``, and how far apart similar sets of a band can be.

    Sets of similarity at least num / den lie in one band or in adjoining ones.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.tops = [0]

    def of(self, size: int) -> int:
        """The band of a size: bands begin at 1 and reach to their first size over the similarity."""
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.tops, size))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return self.tops[band]

    def apart(self, a: int, b: int) -> int:
        """Most elements that only one of two similar sets of these sizes has."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def apart_in(self, size: int, band: int) -> int:
        """The same for a set and any that is no smaller, in a band or below it."""
        return self.apart(size, min(self.top(band), size * self.den // self.num))


@lru_cache(maxsize=4096)
def plan(k: int) -> tuple[int, int]:
    """(parts, cells of a part) of the domain for sets that differ in at most k elements.

    Of k // 2 + 1 parts one has at most one difference, so all its cells but one
    agree. Some more parts make up for cells that are empty.
    """
    parts = k // 2 + 1
    return parts + (math.ceil(0.012 * parts + 0.12 * math.sqrt(parts)) if parts > 3 else 0), 3 if k <= THREES else 2


@lru_cache(maxsize=4096)
def numbers(cells: int, salt: int) -> np.ndarray:
    """A value for each cell of a partition."""
    return mixed(np.arange(cells, dtype=U64), salt + 17)


def signatures(runs: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set of hashes; sets as similar as ``bands`` asks share one, unless they are equal.

    The set is signed for its own band of sizes and for the next, so that two
    similar sets meet in the larger one's band. There the domain falls into
    parts, each of two or three cells. A signature is what all cells but one of
    a part hold. Two sets that differ in at most k elements agree in one: of
    a part's signatures that hold anything, one difference spoils those of one
    cell, so as many differences as the part has filled cells, at most two, are
    needed to spoil all. Parts count until these numbers pass k; further parts
    are not signed, by either set. A set with too many empty cells signs all
    parts and is partitioned anew, and so are all its like.
    """
    size = len(runs)
    if not size:
        return np.zeros(0, np.int64)
    band = bands.of(size)
    values = mixed(runs, 1)
    out = []
    for tag in (band, band + 1):
        need = bands.apart_in(size, tag)
        if need < 1:
            continue  # only equal sets are as similar
        parts, cells = plan(bands.apart(bands.top(tag), bands.top(tag)))
        for salt in range(SALTS):
            place = mixed(runs, 2 + salt * 1_000_003 + tag)
            at = ((place >> U64(32)) * U64(parts) >> U64(32)) * U64(cells) + ((place & U64(0xFFFFFFFF)) * U64(cells) >> U64(32))
            at = at.astype(np.int64)
            counts = np.bincount(at, minlength=parts * cells).reshape(parts, cells)
            sums = np.zeros(parts * cells, U64)
            np.add.at(sums, at, values)
            spoilt_by = np.minimum((counts > 0).sum(1), 2).cumsum()
            enough = int(np.searchsorted(spoilt_by, need + 1)) + 1  # parts that are signed
            sums, counts = sums.reshape(parts, cells)[:enough], counts[:enough]
            # what all cells of the part but one hold, which a sum tells
            others = sums.sum(1, dtype=U64)[:, None] - sums
            key = mixed(mixed(others.ravel(), tag) + numbers(parts * cells, salt)[: others.size])
            out.append(key[(counts.sum(1)[:, None] > counts).ravel()])
            if enough <= parts:
                break
        else:
            out.append(mixed(np.array([tag], U64), 3))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def node_of(runs: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(runs.tobytes()), ">i8")[0])


# --- the join ---------------------------------------------------------------------


def signed_rows(docs: DataFrame, keep: dict[str, Column], text: Column, size: int, num: int, den: int) -> DataFrame:
    """``keep`` columns, node, n_shingles and, for a task's first copy of a set, its signatures, keys, and its parity."""
    bands = Bands(num, den)
    picked = docs.select(*[c.alias(name) for name, c in keep.items()], text.alias("text"))
    names = list(keep)
    schema = T.StructType([*[f for f in picked.schema if f.name != "text"], *T._parse_datatype_string("node long, n_shingles long, keys array<long>, parity binary")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                nodes, sizes, keys, parities = [], [], [], []
                for x in batch.column("text"):
                    runs = set_of(x.as_py(), size)
                    node = node_of(runs) if len(runs) else None
                    nodes.append(node)
                    sizes.append(len(runs))
                    new = node is not None and node not in seen
                    keys.append(signatures(runs, bands) if new else None)
                    parities.append(parity(runs).tobytes() if new else None)
                    seen.add(node)
                made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], *made], schema=arrow)

    return picked.mapInArrow(run, schema)


def shared_keys(postings: DataFrame) -> DataFrame:
    """(key, node) of the keys that different nodes have, of which a node comes once.

    Texts that share a passage meet in many keys. Keys of the same nodes are one,
    which is named by a digest of its nodes; should two sets of nodes have one
    digest, they only meet in one key.
    """
    by = Window.partitionBy("key")
    met = postings.withColumns({"low": F.min("node").over(by), "high": F.max("node").over(by)}).where("low < high")
    named = met.select("key", "node").distinct().withColumn("nodes", F.bit_xor(F.xxhash64("node")).over(by))
    return named.select(F.col("nodes").alias("key"), "node").distinct()


def similar_sets(told: DataFrame, shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links (a, b) that connect what all similar pairs with a key in common would connect, each verified exactly.

    ``told`` has node, size and parity; ``shared`` (a written table) key and
    node; ``sets_of`` gives the sets of the nodes of pairs. Every node of a key
    is first tried against one leader, the node with the most neighbours, which
    is the same in most keys of a group of near copies: this takes one pair a
    member. What then still is apart in a key is compared by cross_links. Whole
    sets are looked at only where parities don't tell.
    """
    crowd = shared.groupBy("key").agg(F.count("*").alias("n"))
    weighed = shared.join(crowd, "key")
    weights = weighed.groupBy("node").agg(F.sum("n").alias("weight")).join(told.select("node", "size"), "node")
    keyed = stage(shared.join(weights, "node"), "weighed-keys")
    leaders = keyed.groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("weight", "node")).alias("l"))
    near = (F.col("node") != F.col("l.node")) & (F.least("size", "l.size") >= F.greatest("size", "l.size") * similarity - 1e-6)
    pairs = keyed.join(leaders, "key").where(near).select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
    pairs = stage(sifted_pairs(pairs, told, similarity), "undecided-leaders")
    links = stage(similar(pairs, sets_of(pairs), similarity), "leader-links")
    placed = stage(keyed.select("key", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-keys")
    mixed_keys = placed.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    rest = stage(placed.join(mixed_keys, "key"), "keys-left")
    return links.unionByName(cross_links(rest, told, sets_of, similarity))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of distinct shingles and component of every document, linked at a similarity of num / den or more.

    A document's set has the distinct runs of ``size`` words of its whole text,
    A-Z lower-cased; with fewer words, the whole sequence is its only one.
    Candidates share a PartEnum signature (``signatures``), which all pairs as
    similar do, and are verified on the whole sets. Equal sets are one node:
    copies cost nothing more.

    Returns doc_id, n_shingles and component_id (the smallest id reachable), one
    row per input row. Null, empty and blank texts have an empty set, are linked
    with nothing and keep their own id. Repeated rows stay. A null id names a
    component only if it has no other. Empty tables give no rows; other columns
    are ignored. Shingles and sets are told apart by 64-bit hashes.
    """

    text, similarity = F.col(text_col), num / den
    text_key = F.xxhash64(F.coalesce(text, F.lit("")))
    with scope() as wide:  # the signatures are read once
        signed = stage(signed_rows(docs, {"doc_id": F.col(id_col), "text_key": text_key}, text, size, num, den), "signed-rows")
    rows = stage(signed.drop("keys", "parity"), "shingle-rows")
    shared = stage(shared_keys(signed.select("node", F.explode("keys").alias("key"))), "shared-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.min("text_key").alias("text_key"), F.first("parity", ignorenulls=True).alias("parity"))
    nodes = stage(nodes, "shingle-nodes")
    wide.drop(docs.sparkSession)

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "text_key"), "node")
        wanted = stage(wanted, "nodes-to-verify")
        picked = likely(docs.select(text_key.alias("text_key"), text.alias("text")), "text_key", wanted).join(wanted, "text_key").dropDuplicates(["node"])
        return stage(fingerprint_rows(picked, {"node": F.col("node")}, F.col("text"), "runs array<long>", lambda x: (set_of(x, size).view("<i8"),)), "shingle-sets")

    links = similar_sets(nodes.select("node", "size", "parity"), shared, sets_of, similarity)
    roots = components(links)
    named = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage(named, "rooted-nodes")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    told = stage(named.join(least, "root").select("node", "component_id"), "named-components")
    empty = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("node is not null").join(told, "node").select("doc_id", "n_shingles", "component_id").unionByName(empty)


#: DuckDB SQL of jaccard_components over documents: all pairs with a shingle in common.
JACCARD_SQL = r"""
with doc as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), run as (
  select d, doc_id, unnest(range(greatest(len(words) - 4, 1))) as pos, words from doc where len(words) > 0
), shingle as (
  select distinct d, array_to_string(words[pos + 1 : pos + 5], ' ') as s from run
), counted as (
  select doc.d, doc_id, count(s) as n from doc left join shingle using (d) group by 1, 2
), node as (
  select d, min(d) over (partition by shingles) as head from (select d, list(s order by s) as shingles from shingle group by d)
), pair as (
  select a.d as a, b.d as b, count(*) as c from shingle a join shingle b using (s) where a.d in (select head from node) and b.d in (select head from node) and a.d <> b.d group by 1, 2
), link as (
  select p.a, p.b from pair p join counted x on x.d = p.a join counted y on y.d = p.b where 100 * p.c >= 80 * (x.n + y.n - p.c)
), reach as (
  with recursive r(a, b) as (select head, head from node union select r.a, l.b from r join link l on l.a = r.b) select * from r
), least as (
  select r.a as head, min(c.doc_id) as component_id from reach r join node m on m.head = r.b join counted c on c.d = m.d group by 1
)
select c.doc_id, c.n::bigint as n_shingles, case when c.n = 0 then c.doc_id else l.component_id end as component_id
from counted c left join node m on m.d = c.d left join least l on l.head = m.head
"""
