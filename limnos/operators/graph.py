"""Connected components of link tables too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.skew import salted_join
from limnos.storage import stage


#: So many links, a few hundred kilobytes, end in one task; more of them are contracted first.
LAST_LINKS = 20_000


def _finished(links: DataFrame) -> DataFrame:
    """(node, root) of at most LAST_LINKS ordered links, whose nodes are of any type, in one task."""
    nodes = links.select(F.col("lo").alias("node")).union(links.select("hi")).distinct()
    numbered = nodes.repartition(1).sortWithinPartitions("node").withColumn("at", F.monotonically_increasing_id())
    numbered = stage(numbered, "component-numbers")
    lo, hi = (numbered.select(F.col("node").alias(c), F.col("at").alias(f"{c}_at")) for c in ("lo", "hi"))
    pairs = links.join(lo, "lo").join(hi, "hi").select("lo_at", "hi_at")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("lo_at", "hi_at")), strict=True):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(parent) if find(x) != x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["at", "root_at"])

    found = pairs.repartition(1).mapInArrow(unite, "at long, root_at long")
    return found.join(numbered, "at").join(numbered.select(F.col("at").alias("root_at"), F.col("node").alias("root")), "root_at").select("node", "root")


def _shortened(parent: DataFrame) -> DataFrame:
    """Follow ``root`` until every node points to its root; each pass doubles the step. Other columns stay."""
    kept = parent.columns
    parent = stage(parent, "component-parents")
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = salted_join(parent, up, "root", "left").withColumns({"root": F.coalesce("above", "root"), "moved": F.col("above").isNotNull()})
        parent = stage(moved.select(*kept, "moved"), "component-parents")
        if parent.where("moved").isEmpty():
            return parent.select(*kept)
        parent = parent.select(*kept)


def _ordered(links: DataFrame) -> DataFrame:
    """Links (a, b) as distinct (lo, hi) without loops."""
    return links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots, which are their component's smallest.

    In each round every node hooks to its smallest neighbour if that is smaller,
    chains are shortened to their roots by doubling, and links between roots
    remain. When they are few, one task ends the work. The links that nodes hook along, which are most of those of a large
    group's smallest node, are done with; the others meet the roots in salted
    joins. At least half of the linked nodes go in each round; rounds write
    their tables, so none repeats another's plan. Nulls are no nodes; loops and
    repeated links do nothing.
    """
    rest = stage(_ordered(links), "component-links")
    rounds = []
    while n := rest.count():
        if n <= LAST_LINKS:
            rounds.append(stage(_finished(rest), "last-components"))
            break
        parent = _shortened(rest.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("hook"), F.min("lo").alias("root")))
        rounds.append(parent.select("node", "root"))
        high = parent.select(F.col("node").alias("hi"), "hook", F.col("root").alias("b"))
        others = stage(salted_join(rest, high, "hi").where("lo <> hook").select("lo", "b"), "component-crossings")
        low = parent.select(F.col("node").alias("lo"), "root")
        rest = stage(_ordered(salted_join(others, low, "lo", "left").select(F.coalesce("root", "lo").alias("a"), "b")), "component-links")
    if not rounds:
        return rest.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    found = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        later = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = salted_join(earlier, later, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(found)
    return stage(found, "components")
