"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions alone."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.columns import unused
from limnos.storage import stage

SHINGLE = 5
SIMILARITY = 0.8
#: At the least similarity an item and its window differ in 15 % of the bits:
#: 9.7 of 64, with a deviation of 2.9. A radius of 20 is 3.6 deviations above.
RADIUS = 20
BLOCKS = 8
#: Shingles and items of the benchmark that are broadcast at once; more items go in further blocks.
ITEM_SHINGLES, ITEMS = 1_000_000, 10_000
#: Two bits, each in a 32-bit lane of its own.
LANES = [(v & 1) | (v >> 1) << 32 for v in range(4)]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(words, "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of each run of so many words; of the whole sequence where there are fewer."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(n > size, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def simhash(hashes: Column) -> Column:
    """A signed 64-bit fingerprint: bits set in over half of the hashes, repeats included.

    Thirty-two long counters hold two 32-bit lanes each, more than an array has
    elements: one pass over the hashes looks up the lanes of every two bits and
    adds them.
    """
    lanes = F.array(*[F.lit(x).cast("long") for x in LANES])
    two = lambda h, k: F.shiftrightunsigned(h, 2 * k).bitwiseAND(F.lit(3).cast("long")).cast("int")
    start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(32)])
    add = lambda acc, h: F.struct(*[(acc[f"c{k}"] + F.element_at(lanes, two(h, k) + 1)).alias(f"c{k}") for k in range(32)])

    def bits(counts: Column, n: Column) -> Column:
        over = lambda b: F.shiftrightunsigned(counts[f"c{b // 2}"], 32 * (b % 2)).bitwiseAND(F.lit((1 << 32) - 1)) * 2 > n
        each = [F.when(over(b), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
        return reduce(lambda x, y: x.bitwiseOR(y), each)

    return let(hashes, lambda all_: let(F.aggregate(all_, start, add), lambda counts: bits(counts, F.size(all_))))


def _block(fp: Column, k: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")


def numbered(hashes: Column) -> Column:
    """A multiset as a set: each hash is mixed with how many like it came before. Linear but for the sort."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n))
        one = lambda a, b: F.transform(F.sequence(F.lit(0), b - a - 1), lambda k: F.xxhash64(F.get(ordered, a), k))
        return let(starts, lambda s: F.flatten(F.zip_with(s, ends(s), one)))

    def mixed(hashes: Column) -> Column:
        first = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), first).otherwise(let(F.array_sort(hashes), runs))

    return let(hashes, mixed)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two multisets that ``numbered`` made."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def prepared_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, hashes, m (their number), fp and bag of each item that has words."""
    hashed = items.select(F.col(id_col).alias("item_id"), shingle_hashes(words_of(F.col(text_col))).alias("hashes")).where(F.size("hashes") > 0).withColumn("m", F.size("hashes"))
    return hashed.withColumn("fp", simhash(F.col("hashes"))).withColumn("bag", numbered(F.col("hashes")))


def _leaks_of_block(hashed: DataFrame, items: DataFrame, keys: list[str], radius: int, similarity: float) -> DataFrame:
    sizes = items.select(F.explode(F.array_distinct("hashes")).alias("hash"), "m").distinct()
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    windows = (
        hashed.select(*keys, "hashes", "n", F.posexplode_outer("hashes").alias("pos", "hash"))
        .join(F.broadcast(sizes), "hash")
        .select(*keys, "m", F.least(F.col("pos"), last).alias("start"), F.slice(F.col("hashes"), F.least(F.col("pos"), last) + 1, F.col("m")).alias("window"))
    )
    # written here, so that the pass over all shingles stays one small generated loop
    marked = stage(stage(windows, "benchmark-windows").withColumn("fp", simhash(F.col("window"))), "window-fingerprints")

    width, reach = 64 // BLOCKS, radius // BLOCKS
    near = [sum(1 << b for b in flips) for r in range(reach + 1) for flips in itertools.combinations(range(width), r)]
    index = items.select("item_id", F.col("m").alias("item_m"), F.col("fp").alias("item_fp"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)])).alias("at"))
    index = index.select("item_id", "item_m", "item_fp", F.col("at.k").alias("item_k"), F.explode(F.array(*[F.col("at.v").bitwiseXOR(F.lit(x)) for x in near])).alias("item_v"))
    probes = marked.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)])))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, k)) <= reach, F.lit(k)) for k in range(BLOCKS)])
    candidates = probes.join(
        F.broadcast(index),
        (F.col("m") == F.col("item_m")) & (F.col("at.k") == F.col("item_k")) & (F.col("at.v") == F.col("item_v")) & (F.bit_count(apart) <= radius) & (first == F.col("item_k")),
    ).select(*keys, "item_id", "start", "window")
    bags = items.select(F.col("item_id").alias("bag_of"), "bag")
    verified = candidates.join(F.broadcast(bags), F.col("item_id").eqNullSafe(F.col("bag_of"))).withColumn("similarity", let(numbered(F.col("window")), lambda w: weighted_similarity(w, F.col("bag"))))
    return verified.where(F.col("similarity") >= similarity).groupBy(*keys, "item_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("start").alias("n_windows"))


def blocks_of(items: DataFrame) -> int:
    """In how many blocks the items are broadcast."""
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    return max(1, -(-total["m"] // ITEM_SHINGLES), -(-total["n"] // ITEMS))


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: dict[str, Column], text: Column, item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """Benchmark items that windows of whole documents repeat.

    For each item, windows of as many words run over every document, or the
    whole document where it has fewer. A window's SimHash over its 5-word
    shingles (repeats weigh) is looked up in a multi-index of the items'
    fingerprints: 8 blocks of 8 bits, one of which differs in at most 2 bits if
    all differ in at most 20, so every fingerprint within the radius is found.
    The similarity of the weighted shingles then verifies each candidate.

    Windows are built where they can match at all: sliding a window on to its
    first shingle that is in the benchmark loses none in common, so only
    windows that begin with one, or end the document, are fingerprinted.

    The benchmark is prepared once and broadcast in blocks of about ITEMS items
    and ITEM_SHINGLES shingles at most; every block passes over all documents.
    Documents' texts are not shuffled; what meets by key is the verified rows.
    A copy of an item of m shingles gives m windows of m hashes, so items of
    many thousands of words are dear.

    Returns the ``keys`` columns, item_id, similarity (the largest) and
    n_windows, a row for each key and item. Null and blank texts match nothing,
    and items without words match nothing. Items with fewer than five words are
    one shingle. Equal items each match. Rows with equal keys are one.
    """
    items = stage(prepared_items(benchmark, item_id, item_text), "benchmark-items")
    blocks = blocks_of(items)
    names = list(keys)
    picked = docs.select(*[c.alias(k) for k, c in keys.items()], words_of(text).alias("_words"))
    hashed = picked.select(*names, shingle_hashes(F.col("_words")).alias("hashes")).withColumn("n", F.size("hashes"))
    parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "fp"), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, [_leaks_of_block(hashed, part, names, radius, similarity) for part in parts])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that repeat a benchmark item; all columns stay, whatever their names.

    Rows are known by id and a digest of their text, so of documents with one id
    only those with a leaking text go, and null ids are ids as well. Repeated
    rows go together. Null and blank texts stay.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    names = [unused(docs, c) for c in ("leak_id", "leak_key", "text_key")]
    leaks = find_leaks(docs, benchmark, {names[0]: F.col(id_col), names[1]: digest}, F.col(text_col))
    gone = stage(leaks.select(names[0], names[1]).distinct(), "leaking-documents")
    known = docs.withColumn(names[2], digest)
    return known.join(gone, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_anti").select(*docs.columns)


#: DuckDB SQL of find_leaks over documents and benchmark, without fingerprints: every window against every item.
LEAKS_SQL = r"""
with doc as (
  select row_number() over () as row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as words from documents
), item as (
  select row_number() over () as item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as words from benchmark
), doc_runs as (
  select row, doc_id, unnest(range(greatest(len(words) - 4, 1))) as pos, words from doc where len(words) > 0
), ds as (
  select row, doc_id, pos, array_to_string(words[pos + 1 : pos + 5], ' ') as s, greatest(len(words) - 4, 1) as n from doc_runs
), item_runs as (
  select item, item_id, unnest(range(greatest(len(words) - 4, 1))) as pos, words from item where len(words) > 0
), its as (
  select item, item_id, array_to_string(words[pos + 1 : pos + 5], ' ') as s, greatest(len(words) - 4, 1) as m from item_runs
), item_counts as (
  select item, item_id, s, m, count(*) as c from its group by all
), starts as (
  select distinct ds.row, ds.doc_id, i.item, i.item_id, i.m, least(ds.pos, greatest(0, ds.n - i.m)) as start, least(ds.n, i.m) as w from ds join item_counts i using (s)
), window_counts as (
  select t.row, t.doc_id, t.item, t.item_id, t.m, t.start, t.w, d.s, count(*) as c
  from starts t join ds d on d.row = t.row and d.pos between t.start and t.start + t.m - 1 group by all
), common as (
  select x.doc_id, x.item_id, x.row, x.item, x.start, x.m, x.w, sum(least(x.c, i.c)) as common
  from window_counts x join item_counts i on i.item = x.item and i.s = x.s group by all
), likeness as (
  select doc_id, item_id, start, common::double / (m + w - common)::double as similarity from common
)
select doc_id, item_id, round(max(similarity), 9) as similarity, count(distinct start)::bigint as n_windows from likeness where similarity >= 0.8 group by all
"""
