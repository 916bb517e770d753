"""Exact links between sets that meet in large buckets, sifted in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.graph import components
from limnos.storage import stage

#: Sets in a block, and bytes of their parities, about and at most.
BLOCK_SETS, BLOCK_BYTES = 8192, 8_000_000
#: Rows of small parts that a task handles at once, about.
BIN_ROWS = 5000
#: Bits of a parity for each element of a set, and their least and largest number: powers of two.
SPREAD, LEAST_BITS, MOST_BITS = 4, 512, 1 << 18
#: By so much the parities are shorter that sets meet with in large parts.
SHORTER = 4


def parity(runs: np.ndarray) -> np.ndarray:
    """For each of so many cells that hashes fall into, whether their number is odd: as bits, in 64-bit words.

    Two sets' parities differ in at most as many bits as one of the sets alone
    has elements. Halves under exclusive or are the parity of half the cells.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (SPREAD * max(len(runs), 1) - 1).bit_length()))
    mixed = runs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount((mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parities (one a row) of fewer cells: the upper bits of a hash choose its cell, so neighbours are joined."""
    while words.shape[1] > size:
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        words = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little").view("<u8")
    return words


def with_parities(sets: DataFrame) -> DataFrame:
    """(node, size, parity) of sets (node, runs)."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [x.values.to_numpy() for x in batch.column("runs")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in runs], pa.int64()), pa.array([parity(x).tobytes() for x in runs], pa.binary())], ["node", "size", "parity"])

    return sets.select("node", "runs").mapInArrow(run, f"node {kind}, size long, parity binary")


def with_short_parities(told: DataFrame) -> DataFrame:
    """``told`` (node, size, parity) with parities of fewer cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parities = batch.column("parity").to_pylist()
            out: list[bytes] = [b""] * len(parities)
            by_width: dict[int, list[int]] = {}
            for k, x in enumerate(parities):
                by_width.setdefault(len(x) // 8, []).append(k)
            for width, at in by_width.items():
                short = folded(np.frombuffer(b"".join(parities[k] for k in at), "<u8").reshape(-1, width), max(width // SHORTER, LEAST_BITS // 64))
                for k, words in zip(at, short, strict=True):
                    out[k] = words.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array(out, pa.binary())], ["node", "size", "parity"])

    return told.select("node", "size", "parity").mapInArrow(run, "node long, size long, parity binary")


def sifted_pairs(pairs: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the parities of ``told`` (node, size, parity) let be as similar."""
    x, y = (told.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab")
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[np.frombuffer(p, "<u8") for p in batch.column(c).to_pylist()] for c in ("parity_a", "parity_b")]
            sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            by_width: dict[tuple[int, int], list[int]] = {}
            for k, (p, q) in enumerate(zip(*words, strict=True)):
                by_width.setdefault((len(p), len(q)), []).append(k)
            kept = np.zeros(batch.num_rows, bool)
            for widths, at in by_width.items():
                p, q = (folded(np.stack([w[k] for k in at]), min(widths)) for w in words)
                kept[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= sizes[at] * apart + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("a", "b")], ["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


class Block:
    """Sets (node, root, size, parity) in their order: parities by their number of words, and all folded to the least."""

    def __init__(self, rows: list[tuple], similarity: float) -> None:
        self.apart = (1 - similarity) / (1 + similarity)  # what only one of two such sets has, of their sizes' sum, at most
        self.node, self.root, self.size = (np.array([x[k] for x in rows], np.int64) for k in range(3))
        self.width = np.array([len(x[3]) // 8 for x in rows], np.int64)
        self.coarse = np.zeros((len(rows), LEAST_BITS // 64), np.uint64)
        self.words: dict[int, np.ndarray] = {}
        self.at = np.zeros(len(rows), np.int64)  # place among those of its width
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.at[own] = np.arange(len(own))
            self.words[width] = np.frombuffer(b"".join(rows[k][3] for k in own), "<u8").reshape(-1, width)
            self.coarse[own] = folded(self.words[width], LEAST_BITS // 64)

    def settled(self, i: np.ndarray, other: Block, j: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs (i, j) with different roots that sizes, short parities and then whole ones let be similar, the smaller node first."""
        out: list[tuple[int, int]] = []
        most = lambda i, j: (self.size[i] + other.size[j]) * self.apart + 1e-6
        ok = (self.root[i] != other.root[j]) & (np.abs(self.size[i] - other.size[j]) <= most(i, j))
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(self.coarse[i] ^ other.coarse[j]).sum(1, dtype=np.int64) <= most(i, j)
        i, j = i[ok], j[ok]
        for v, w in {*zip(self.width[i].tolist(), other.width[j].tolist(), strict=True)}:
            own = (self.width[i] == v) & (other.width[j] == w)
            x, y = i[own], j[own]
            p, q = folded(self.words[v][self.at[x]], min(v, w)), folded(other.words[w][other.at[y]], min(v, w))
            kept = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= most(x, y)
            a, b = self.node[x[kept]], other.node[y[kept]]
            out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)
        return out


#: Pairs that are looked at together.
PAIRS = 200_000


def undecided(left: list[tuple], right: list[tuple] | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of (node, root, size, parity) of two blocks, or of one, that sizes and parities let be as similar."""
    a = Block(sorted(left, key=lambda x: x[2]), similarity)
    b = a if right is None else Block(sorted(right, key=lambda x: x[2]), similarity)
    low = np.searchsorted(b.size, a.size * similarity - 1e-6)
    high = np.searchsorted(b.size, a.size / similarity + 1e-6, side="right")
    if right is None:
        low = np.maximum(low, np.arange(len(a.node)) + 1)
    counts = np.maximum(high - low, 0)
    out: list[tuple[int, int]] = []
    start = 0
    while start < len(counts):  # so many rows at once that their pairs are about PAIRS
        stop = start + max(1, int(np.searchsorted(np.cumsum(counts[start:]), PAIRS)))
        n = counts[start:stop]
        i = np.repeat(np.arange(start, start + len(n)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]
        out += a.settled(i, b, j)
        start = stop
    return out


def undecided_of_parts(parts: list[int], rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """The same for the pairs of each of many small parts; rows of a part stand together."""
    block = Block(rows, similarity)
    starts = [k for k in range(len(parts)) if k == 0 or parts[k] != parts[k - 1]]
    triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out: list[tuple[int, int]] = []
    i, j, waiting = [], [], 0
    for start, stop in zip(starts, [*starts[1:], len(parts)], strict=True):
        n = stop - start
        if n not in triangles:
            triangles[n] = np.triu_indices(n, 1)
        i.append(triangles[n][0] + start)
        j.append(triangles[n][1] + start)
        waiting += len(i[-1])
        if waiting > PAIRS:
            out += block.settled(np.concatenate(i), block, np.concatenate(j))
            i, j, waiting = [], [], 0
    return out + block.settled(np.concatenate(i), block, np.concatenate(j)) if i else out


def sifted(table: pa.Table, similarity: float) -> pa.Table:
    """The undecided pairs (a, b) of two blocks of a part (side 0 and 1), of its one, or of many small parts (kind -1)."""
    if table.column("kind")[0].as_py() < 0:
        table = table.sort_by("within")
    rows = list(zip(*(table.column(c).to_pylist() for c in ("node", "root", "size", "parity")), strict=True))
    if table.column("kind")[0].as_py() < 0:
        pairs = undecided_of_parts(table.column("within").to_pylist(), rows, similarity)
    else:
        sides = table.column("side").to_pylist()
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = ([r for r, s in zip(rows, sides, strict=True) if s == k] for k in (0, 1))
        pairs = undecided(left, None if one else right, similarity)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return sized.where(F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common")) - 1e-6).select("a", "b")


def cross_links(met: DataFrame, told: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links (a, b): all pairs of one key with different roots whose similarity (Jaccard) is ``similarity`` or more.

    ``met`` (a written table) has key, node and root; ``told`` node, size and
    parity; ``sets_of`` gives, for pairs (a, b), node and runs, the distinct
    hashes of the set, of each of their nodes. No pair is lost, and hardly a
    pair that fails is a row: sets meet as parities, a few bits for each
    element, in tasks of two blocks of bounded size, and a pair leaves the task
    only if its parities differ in no more bits than such sets may have
    elements apart. At a limit of 0.8 that is hardly a pair below 0.75; longer
    parities then leave none below about 0.77, and the whole sets decide.

    Texts that share a frame meet in many keys. Keys that chain together are
    compared as one group, each pair once, where that is no more work than all
    their keys are one by one. A group of any size is dealt to blocks.
    """
    if met.isEmpty():
        return met.select(F.col("node").alias("a"), F.col("node").alias("b"))
    heads = met.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    keyed = met.join(heads, "key")
    chains = components(keyed.select(F.col("node").alias("a"), F.col("head").alias("b")))
    placed = stage(keyed.join(chains.withColumnRenamed("root", "chain"), "node", "left").withColumn("chain", F.coalesce("chain", "node")), "chained-keys")
    members = placed.select("chain", "node", "root").distinct()
    by_keys = placed.groupBy("chain", "key").agg(F.first("n").alias("n")).groupBy("chain").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    whole = members.groupBy("chain").agg(F.count("*").alias("m")).join(by_keys, "chain").select("chain", (F.col("m").cast("double") * F.col("m") <= F.col("pairs")).alias("whole"))
    whole = stage(whole, "chains")
    part = F.when(F.col("whole"), F.col("chain")).otherwise(F.col("key"))
    parts = placed.join(whole, "chain").select(F.when(F.col("whole"), 0).otherwise(1).alias("kind"), part.alias("part"), "node", "root").distinct()
    parts = stage(parts, "parts")
    # parities come to the rows last, when these are dealt: only then they are shuffled
    short = stage(with_short_parities(told.join(met.select("node").distinct(), "node")), "short-parities")
    long = short.select("node", F.octet_length("parity").alias("bytes"))
    sized = parts.join(long, "node").groupBy("kind", "part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = parts.join(sized, ["kind", "part"])
    columns = ["kind", "part", "i", "j", "side", "within", "node", "root"]
    # parts of one block, which are many and mostly small, are handled some thousands of rows at once
    bins = max(1, met.count() // BIN_ROWS)
    zero = F.lit(0).cast("long")
    small = dealt.where("blocks = 1").withColumn("within", F.xxhash64("kind", "part"))
    small = small.withColumns({"kind": F.lit(-1), "part": F.pmod(F.col("within"), F.lit(bins)), "i": zero, "j": zero, "side": F.lit(0)}).select(columns)
    large = dealt.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    large = large.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    large = large.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int"), "within": zero}).select(columns)
    dealt = small.unionByName(large).join(short, "node").select(*columns, "size", "parity")
    pairs = stage(dealt.groupBy("kind", "part", "i", "j").applyInArrow(lambda table: sifted(table, similarity), "a long, b long").distinct(), "undecided-pairs")
    pairs = stage(sifted_pairs(pairs, told, similarity), "pairs-to-verify")
    return stage(similar(pairs, sets_of(pairs), similarity), "block-links")
