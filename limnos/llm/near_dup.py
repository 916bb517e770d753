"""SimHash near-duplicates by generalised pigeonhole search."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.block_links import cross_links, similar, with_parities
from limnos.columns import unused
from limnos.operators.graph import components
from limnos.operators.skew import salted_join
from limnos.storage import stage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A byte's bits, each in a byte of its own.
SPREAD = np.array([sum((v >> k & 1) << (8 * k) for k in range(8)) for v in range(256)], "<u8")
SLICE = 255 * 256
#: What a shuffled row costs in the choice of thresholds, in comparisons of two fingerprints.
ROW_COST = 10.0
#: 64-bit words of the fingerprint that estimates a similarity.
WIDE = 16
#: Bands of min-hashes, and min-hashes in each.
BANDS, BAND_ROWS = 32, 8


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of so many words, space-joined; the whole sequence where there are fewer."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashes_of(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in items), "<u8", len(items))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, summed in slices of bounded size."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        lanes = SPREAD[np.ascontiguousarray(hashes[at : at + SLICE]).view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a lane holds 255 at most
        total += np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def wide_simhash(hashes: np.ndarray) -> list[int]:
    """A plain SimHash and fifteen of remixed hashes: 1024 bits to estimate similarity with."""
    total = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(hashes), 255 * 16):
        h = (hashes[at : at + 255 * 16, None] + np.arange(WIDE, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        h[:, 0] = hashes[at : at + 255 * 16]
        sums = np.add.reduceat(SPREAD[h.view(np.uint8)], np.arange(0, len(h), 255), axis=0)
        total += np.ascontiguousarray(sums).view(np.uint8).reshape(-1, WIDE * 64).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<i8").tolist()


TURNS, SHIFTS = (hashes_of([b"%s %d" % (kind, k) for k in range(BANDS * BAND_ROWS)]) for kind in (b"turn", b"shift"))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: two sets of hashes have one in common with chance similarity ** BAND_ROWS."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * (TURNS | np.uint64(1)) + SHIFTS).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist()


def fingerprint_rows(docs: DataFrame, keep: dict[str, Column], text: Column, schema: str, describe: Callable[[str | None], tuple]) -> DataFrame:
    """``keep`` columns and what ``describe`` makes of each whole text (columns of ``schema``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = docs.select(*[c.alias(name) for name, c in keep.items()], text.alias("_text"))
    added = T._parse_datatype_string(schema)
    whole = T.StructType([*[f for f in picked.schema if f.name != "_text"], *added])
    arrow = to_arrow_schema(whole)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(describe(x.as_py()) for x in batch.column("_text")), strict=True)) or [()] * len(added)
            columns = [pa.array(c, arrow.field(f.name).type) for c, f in zip(made, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], schema=arrow)

    return picked.mapInArrow(run, whole)


# --- generalised pigeonhole ---------------------------------------------------


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits in how many both are set."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)].astype(np.float32)
                total += (part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(total.ravel(), pa.int64())], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(gram, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096, np.int64)
    for r in rows:  # 64 x 64 cells at most
        both[r["cell"]] = r["n"]
    return nodes.count(), both.reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts of even size, correlated bits together."""
    share = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(deviation, deviation))
    np.fill_diagonal(tie, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: tie[b, group].sum()))
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def block(fp: Column, bits: list[int]) -> Column:
    """The part's bits of a fingerprint, packed."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in itertools.combinations(range(width), r)]


def within(p: np.ndarray, radius: int) -> float:
    """Chance that at most ``radius`` of independent bits with these chances differ."""
    dist = np.array([1.0])
    for q in p:
        dist = np.convolve(dist, [1 - q, q])
    return float(dist[: radius + 1].sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) of each part that sum to ``total`` at the least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, c in enumerate(options, start=-1):
                if cost + c < new.get(so_far + t, (math.inf,))[0]:
                    new[so_far + t] = (cost + c, [*chosen, t])
        best = new
    return best.get(total, (math.inf, []))


def search_plan(nodes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed.

    If two fingerprints differ in at most ``radius`` bits, they differ in at
    most t of a part's bits for some part, as long as the thresholds sum to
    radius - parts + 1. For several numbers of parts, the pairs that agree in a
    part are counted over all fingerprints, those that nearly agree estimated
    from the counts and the bits' frequencies, and a dynamic programme finds
    the cheapest thresholds; a probe's rows count as well.
    """
    n, both = together(nodes)
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    options = {m: grouped_bits(n, both, m) for m in range(2, min(radius + 1, 8) + 1)} or {1: [list(range(64))]}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), block(F.col("fp"), bits).alias("v")) for m, groups in options.items() for i, bits in enumerate(groups)]
    counts = nodes.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.v").count()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in counts.groupBy("m", "i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = (math.inf, [])
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            exact = max(within(differ[bits], 0), 1e-30)
            row = [0.0]
            for t in range(min(radius - m + 2, 3)):
                found = max(pairs.get((m, i), 0.0), 1.0) * within(differ[bits], t) / exact
                row.append(min(found, n * n / 2) + ROW_COST * n * sum(math.comb(len(bits), r) for r in range(t + 1)))
            costs.append(row)
        cost, thresholds = allocate(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


Check = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def near_links(nodes: DataFrame, radius: int, also: Check | None = None) -> DataFrame:
    """Links (a, b) that connect what all pairs within ``radius`` would connect.

    ``nodes`` has node (unique), fp and further columns. A pair links where its
    fingerprints differ in at most ``radius`` bits and ``also`` (a condition on
    both rows) holds. Pairs are found by probing the parts of search_plan, so
    none within the radius is missed, and verified where they meet, so pairs
    that don't link are never put out. First every node is tried against one
    leader of each block that it is in, one row a block; then only links across
    the components so far are put out, between those components' names. A group
    of near copies of any size thus gives rows as many as it has members.
    """
    plan = search_plan(nodes, radius)
    extra = [c for c in nodes.columns if c not in ("node", "fp")]

    def good(a: str, b: str) -> Column:
        close = distance(F.col(f"{a}.fp"), F.col(f"{b}.fp")) <= radius
        return close if also is None else close & also(lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}"))

    # part and packed bits in one key; a part has 32 bits at most unless it is the only one
    keys = [block(F.col("fp"), bits) if len(plan) == 1 else block(F.col("fp"), bits).bitwiseOR(F.lit(i << 58).cast("long")) for i, (bits, _) in enumerate(plan)]
    placed = nodes.select("*", F.explode(F.array(*keys)).alias("key"))
    leaders = stage(placed.groupBy("key").agg(F.min_by(F.struct("node", "fp", *extra), "node").alias("x")).select("key", "x.*"), "block-leaders")
    near = placed.alias("a").join(leaders.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & good("a", "b"))
    first = stage(near.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "leader-links")

    named = nodes.join(components(first), "node", "left").select(F.coalesce("root", "node").alias("name"), "fp", *extra)
    named = stage(named, "named-nodes")
    index = named.select("*", F.explode(F.array(*keys)).alias("key"))
    flips = [F.struct(k.alias("key"), F.array(*[F.lit(x).cast("long") for x in ball(len(bits), t)]).alias("flips")) for k, (bits, t) in zip(keys, plan, strict=True)]
    probe = named.select("*", F.explode(F.array(*flips)).alias("p")).select("*", F.explode("p.flips").alias("flip")).withColumn("key", F.col("p.key").bitwiseXOR(F.col("flip"))).drop("p", "flip")
    # a pair that meets in several parts is put out in the first of them, and once
    apart, part = F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.shiftrightunsigned("a.key", 58)
    masks = [sum(1 << b for b in bits) for bits, _ in plan]
    met = [F.when(F.bit_count(apart.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) <= t, F.lit(i)) for i, (m, (_, t)) in enumerate(zip(masks, plan, strict=True))]
    first_met = F.lit(True) if len(plan) == 1 else F.coalesce(*met) == part
    across = probe.alias("a").join(index.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.name") < F.col("b.name")) & good("a", "b") & first_met)
    return first.unionByName(across.select(F.col("a.name").alias("a"), F.col("b.name").alias("b")))


def with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, id and more) with ``root``: the (id, more, node) that comes first in each node's component.

    Null ids come last. Components are formed on these labels, so the smallest
    id is the component's name and nothing meets by name afterwards.
    """
    told = [c for c in nodes.columns if c not in ("node", "id")]
    labelled = nodes.withColumn("label", F.struct(F.col("id").isNull().alias("unnamed"), "id", *told, "node"))
    a = labelled.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labelled.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    links = stage(salted_join(stage(links, "links-to-label"), a, "a"), "half-labelled-links")
    roots = components(salted_join(links, b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return labelled.join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label")).drop("label")


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    A-Z are lower-cased in the whole text; shingles of words, repeats included,
    are hashed with XXH64 (seed 42); a fingerprint bit is set where over half
    of the hashes have it. Fingerprints that differ in at most ``radius`` bits
    link, and component_id is the smallest id that links reach.

    Returns doc_id, fingerprint (16 hex digits) and component_id, one row per
    input row. Null, empty and blank texts have fingerprint zero, linked like
    any other. Equal fingerprints are one node, so copies cost nothing more;
    repeated rows stay. Null ids never name a component unless it has no other.
    Empty tables give no rows; other columns are ignored.
    """
    describe = lambda text: (simhash(hashes_of(shingles(words_of(text), shingle_words))),)
    rows = stage(fingerprint_rows(docs, {"doc_id": F.col(id_col)}, F.col(text_col), "node long", describe), "fingerprints")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("id")).withColumn("fp", F.col("node")), "distinct-fingerprints")
    links = near_links(nodes.select("node", "fp"), radius)
    named = stage(with_components(nodes.select("node", "id"), links).select("node", F.col("root.id").alias("component_id")), "named-fingerprints")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# --- one document of each group of near copies ----------------------------------


def estimated_similarity(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Jaccard similarity of two sets of shingles from their 1024-bit SimHashes and sizes (w0, w1, ..., n_runs).

    The share of differing bits estimates the angle between the sets, and with
    their sizes the number in common. At 0.8 the standard error is 0.026.
    """
    apart = sum((distance(a(f"w{k}"), b(f"w{k}")) for k in range(1, WIDE)), distance(a("w0"), b("w0")))
    common = F.cos(apart * F.lit(math.pi / (64 * WIDE))) * F.sqrt(a("n_runs").cast("double") * b("n_runs"))
    return common / (a("n_runs") + b("n_runs") - common)


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, node, weight) of every band that more than one of ``nodes`` (node, bands) has.

    ``weight`` adds up the sizes of a node's bands: it is largest for the text
    that most others are copies of.
    """
    placed = nodes.select("node", F.explode("bands").alias("key"))
    crowded = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(placed.join(crowded.hint("merge"), "key"), "shared-bands")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    return stage(shared.select("key", "node").join(weights.hint("merge"), "node"), "weighed-bands")


def band_links(nodes: DataFrame, shared: DataFrame, sets: DataFrame, near: Check, similarity: float, before: DataFrame) -> DataFrame:
    """``before`` and further links (a, b), which together connect what all pairs with a band in common and this similarity would connect.

    ``nodes`` has node and what ``near`` reads; ``shared`` is shared_bands(nodes);
    ``sets`` has node and runs. First every band's nodes are tried against its
    heaviest, which in a group of near copies is the same for most bands: one
    pair or few a node, of which those that aren't ``near`` need no look at
    their sets. What is still apart in a band is compared by cross_links, which
    puts out no pair that fails.
    """
    told = nodes.columns

    def with_roots(links: DataFrame) -> DataFrame:
        return shared.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    placed = with_roots(before)
    heaviest = placed.groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("weight", "node")).alias("l"))
    led = placed.join(heaviest, "key").where(F.col("root") != F.col("l.root"))
    pairs = led.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
    x, y = (nodes.select([F.col(c).alias(f"{side}_{c}") for c in told]) for side in "xy")
    tried = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    close = tried.where(near(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))).select("a", "b")
    links = before.unionByName(stage(similar(close, sets, similarity), "leader-links"))
    placed = stage(with_roots(links), "rooted-bands")
    mixed = placed.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    rest = stage(placed.select("key", "node", "root").join(mixed.hint("merge"), "key"), "mixed-bands")
    told = stage(with_parities(sets.join(rest.select("node").distinct(), "node")), "set-parities")
    return links.unionByName(cross_links(rest, told, lambda pairs: sets, similarity))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, margin: float = 0.08, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies.

    Texts are near copies at a similarity (Jaccard, shingles of five words) of
    0.8 or more, and every link is verified exactly on the shingles' 64-bit
    hashes before any components are formed. Candidates come from two searches:

    - SimHashes of the shingles within ``radius`` bits, found by generalised
      pigeonhole as in simhash_components. These are copies with few changes,
      up to a similarity of about 0.97.
    - Texts that share one of 32 bands of eight min-hashes of the shingles. A
      pair at 0.8 is missed with a chance of 1 in 240, one at 0.85 with 1 in
      26,000. A band's texts are first tried against one of them, where a
      1024-bit SimHash estimates a similarity within ``margin`` (three standard
      errors) of the limit; what is then apart is compared in blocks.

    No SimHash alone can do the second part: at 0.8 some 15 % of the bits
    differ, a radius at which any index meets a fixed share of all pairs.

    Groups are the components of the links. Texts equal after lower-casing and
    splitting into words are one node. Null and blank texts form one group. Of
    repeated rows (equal id and text) one stays; a null id yields to others.
    Columns stay as they are, whatever their names. Empty tables give no rows.
    """
    wide = [f"w{k}" for k in range(WIDE)]

    def describe(text: str | None) -> tuple:
        words = words_of(text)
        runs = np.unique(hashes_of(shingles(words, shingle_words)))
        whole = np.frombuffer(xxhash.xxh3_64_digest(b" ".join(words)), ">i8")
        return int(whole[0]), band_keys(runs), len(runs), *wide_simhash(runs)

    schema = "node long, bands array<long>, n_runs int, " + ", ".join(f"{w} long" for w in wide)
    row_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    row_text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = stage(fingerprint_rows(docs, {"id": F.col(id_col), "row_id": row_id, "row_text": row_text}, F.col(text_col), schema, describe), "near-copy-rows")
    first_row = F.min(F.struct(F.col("id").isNull(), "id", "row_id", "row_text")).alias("r")
    nodes = rows.groupBy("node").agg(first_row, *[F.first(c).alias(c) for c in ("bands", "n_runs", *wide)])
    nodes = stage(nodes.select("node", "r.id", "r.row_id", "r.row_text", "bands", "n_runs", *wide), "near-copy-nodes")

    close = stage(near_links(nodes.select("node", F.col("w0").alias("fp")), radius), "close-fingerprints")
    shared = shared_bands(nodes)
    wanted = shared.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = stage(wanted.join(nodes.select("node", "row_id", "row_text"), "node"), "nodes-to-verify")
    sets = stage(shingle_sets(docs.select(row_id.alias("row_id"), row_text.alias("row_text"), F.col(text_col).alias("text")), wanted, shingle_words), "shingle-sets")

    def near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        sizes = F.least(a("n_runs"), b("n_runs")) >= F.greatest(a("n_runs"), b("n_runs")) * F.lit(similarity) - 1e-6
        return sizes & (estimated_similarity(a, b) >= F.lit(similarity - margin))

    before = stage(similar(close, sets, similarity), "verified-links")
    links = band_links(nodes.select("node", "n_runs", *wide), shared, sets, near, similarity, before)
    placed = with_components(nodes.select("node", "id", "row_id", "row_text"), links)
    by = [unused(docs, "row_id"), unused(docs, "row_text")]
    kept = stage(placed.where(F.col("root.node") == F.col("node")).select(F.col("row_id").alias(by[0]), F.col("row_text").alias(by[1])), "kept-rows")
    # the kept rows grow with the documents, so this is no broadcast at any size; repeated rows meet in it
    left = docs.withColumns(dict(zip(by, (row_id, row_text), strict=True))).join(kept.hint("merge"), by, "left_semi")
    return left.dropDuplicates(by).select(*docs.columns)


def shingle_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, runs): the hashes of the distinct shingles of every node of ``wanted`` (node, row_id, row_text), from one row of ``texts`` each."""
    picked = texts.join(wanted.hint("merge"), ["row_id", "row_text"]).dropDuplicates(["row_id", "row_text"])
    describe = lambda text: (np.unique(hashes_of(shingles(words_of(text), size))).view("<i8"),)
    return fingerprint_rows(picked, {"node": F.col("node")}, F.col("text"), "runs array<long>", describe)
