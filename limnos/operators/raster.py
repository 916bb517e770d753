"""Neighbourhood operators on pixel tables.

Windows run over (lake, year, row) and (lake, year, column), so a partition
is one line of one raster, whatever the raster's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.graph import components
from limnos.operators.zonal import PIXEL_HA
from limnos.storage import stage

LINE = ["lake", "yr"]


def box_sum(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Sum of a value over the square window around each cell; cells beyond the grid are absent."""
    across = Window.partitionBy(*LINE, "r").orderBy("c").rangeBetween(-radius, radius)
    down = Window.partitionBy(*LINE, "c").orderBy("r").rangeBetween(-radius, radius)
    return px.withColumn("_across", F.sum(value).over(across)).withColumn(out, F.sum("_across").over(down)).drop("_across")


def mirrored(px: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """The grid with a border mirrored about its edge lines (the edge itself is not repeated)."""
    def images(at: Column, n: int) -> Column:
        every = F.array(at, *[F.when(at.between(1, radius), -at), F.when(at.between(n - 1 - radius, n - 2), 2 * (n - 1) - at)])
        return F.array_compact(every)
    return px.withColumn("r", F.explode(images(F.col("r"), height))).withColumn("c", F.explode(images(F.col("c"), width)))


def texture(px: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Mean and deviation of the 3 x 3 window, with a mirrored border."""
    ext = mirrored(px.select(*LINE, "r", "c", F.col(value).cast("double").alias("v")), 1, height, width).withColumn("vv", F.col("v") * F.col("v"))
    s = box_sum(box_sum(ext, "v", 1, "s"), "vv", 1, "ss").where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    mean = F.col("s") / 9
    return s.select(*LINE, "r", "c", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.col("ss") / 9 - mean * mean, F.lit(0.0))), 4).alias("std"))


def built_share(px: DataFrame, radius: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Share of built cells in the window, of the window's whole size.

    Cells beyond the grid count as not built or, where its size is given, as
    their mirror images about the edge lines.
    """
    b = px.select(*LINE, "r", "c", F.coalesce((F.col("cls") == 3).cast("int"), F.lit(0)).alias("b"))
    if height is not None and width is not None:
        b = box_sum(mirrored(b, radius, height, width), "b", radius, "n").where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    else:
        b = box_sum(b, "b", radius, "n")
    return b.select(*LINE, "r", "c", F.round(F.col("n") / float((2 * radius + 1) ** 2), 6).alias("share"))


def opened(px: DataFrame, mask: str) -> DataFrame:
    """Binary opening by a 3 x 3 square; outside counts as 0."""
    m = px.withColumn("_m", F.coalesce(F.col(mask).cast("int"), F.lit(0)))
    e = box_sum(m, "_m", 1, "_n").withColumn("_e", (F.col("_n") == 9).cast("int"))
    return box_sum(e, "_e", 1, "_d").withColumn("opened", F.col("_d") > 0).drop("_m", "_n", "_e", "_d")


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """For each place x of a line the least f[v] + (x - v) ** 2 over all v, in one pass; f may be infinite."""
    at = np.flatnonzero(np.isfinite(f)).tolist()
    if not at:
        return f
    values = f.tolist()
    hull, begins = [at[0]], [-math.inf]  # parabolas that are lowest somewhere, and from where
    for v in at[1:]:
        while True:
            u = hull[-1]
            x = (values[v] + v * v - values[u] - u * u) / (2 * (v - u))
            if x > begins[-1]:
                break
            hull.pop()
            begins.pop()
        hull.append(v)
        begins.append(x)
    x = np.arange(len(f))
    v = np.array(hull)[np.searchsorted(begins, x, side="right") - 1]
    return f[v] + (x - v) ** 2


#: Cells of lines that are handled at once.
LINE_CELLS = 2_000_000


def distance_to(px: DataFrame, mask: str, cap: float | None, res: float = 20.0) -> DataFrame:
    """Exact distance of each cell's centre to the nearest cell of a mask, at most ``cap`` (and ``cap`` without any).

    First the nearest masked cell of the own column, by windows. Each line of a
    raster is then a row of bounded size, and many lines are handled at once in
    an Arrow batch: up to the cap by shifts of all of them together, without one
    by the lower envelope of each line's parabolas, in one pass over it.
    """
    down = Window.partitionBy(*LINE, "c").orderBy("r")
    above = F.last(F.when(F.col(mask), F.col("r")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(F.when(F.col(mask), F.col("r")), ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))
    column = px.select(*LINE, "r", "c", F.least(F.col("r") - above, below - F.col("r")).cast("double").alias("g"))
    lines = column.groupBy(*LINE, "r").agg(F.collect_list(F.struct("c", "g")).alias("cells"))
    kinds = dict(column.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.list_value_length(batch.column("cells")).to_numpy()
            step = max(1, LINE_CELLS // max(1, int(counts.max(initial=1))))
            for at in range(0, batch.num_rows, step):
                part, n = batch.slice(at, step), counts[at : at + step]
                cells = part.column("cells").flatten()
                c, g = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("c", "g"))
                which = np.repeat(np.arange(part.num_rows), n)
                place = c - np.repeat(np.minimum.reduceat(c, np.cumsum(n) - n), n)
                own = np.full((part.num_rows, int(place.max()) + 1), np.inf)
                own[which, place] = np.where(np.isnan(g), np.inf, g) ** 2
                if cap is None:
                    best = np.stack([lower_envelope(f) for f in own])
                else:
                    best = own.copy()
                    for d in range(1, min(own.shape[1] - 1, int(cap // res)) + 1):
                        np.minimum(best[:, d:], own[:, :-d] + d * d, out=best[:, d:])
                        np.minimum(best[:, :-d], own[:, d:] + d * d, out=best[:, :-d])
                keys = [part.column(k).take(pa.array(which)) for k in (*LINE, "r")]
                yield pa.RecordBatch.from_arrays([*keys, cells.field("c"), pa.array(best[which, place])], [*LINE, "r", "c", "q"])

    best = lines.mapInArrow(run, f"lake {kinds['lake']}, yr {kinds['yr']}, r {kinds['r']}, c {kinds['c']}, q double")
    far = F.sqrt("q") * res
    return best.select(*LINE, "r", "c", F.round(far if cap is None else F.least(far, F.lit(cap)), 4).alias("distance"))


def shoreline(zones: DataFrame, res: float = 20.0) -> DataFrame:
    """Distance of each cell to the other side of the shore: negative inside."""
    z = zones.select("lake", "r", "c", "inside", (~F.col("inside")).alias("outside"), F.lit(0).alias("yr"))
    to_lake, to_land = (distance_to(z, m, None, res).select("lake", "r", "c", F.col("distance").alias(m)) for m in ("inside", "outside"))
    both = to_lake.withColumnRenamed("inside", "a").join(to_land.withColumnRenamed("outside", "b"), ["lake", "r", "c"])
    return both.select("lake", "r", "c", F.when(F.col("a") == 0, -F.col("b")).otherwise(F.col("a")).alias("shore"))


def run_labels(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each cell, in order of rows and columns, the place of the first cell of its patch (8 neighbours)."""
    n = len(r)
    starts = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1))))
    stops = np.append(starts[1:], n)
    row, first, last = r[starts].tolist(), c[starts].tolist(), c[stops - 1].tolist()
    parent = list(range(len(starts)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    above, here = 0, 0
    while here < len(starts):  # two runs of rows next to each other are passed through together
        if row[above] + 1 < row[here] or (row[above] + 1 == row[here] and last[above] + 1 < first[here]):
            above += 1
        elif above == here or row[above] == row[here] or first[above] > last[here] + 1:
            here += 1
        else:
            x, y = find(above), find(here)
            parent[max(x, y)] = min(x, y)
            if last[above] < last[here]:
                above += 1
            else:
                here += 1
    return np.repeat(starts[[find(x) for x in range(len(starts))]], stops - starts)


def patches(px: DataFrame, cls: int, least: int = 1, tile: int = 256) -> DataFrame:
    """Connected patches (8 neighbours) of a class with ``least`` cells or more: every cell with its patch's smallest cell.

    Each tile of a raster is labelled in one task. Only the labels that meet at
    the tiles' borders are then linked and contracted, so the rounds grow with
    the borders, not with the cells, and a patch of any size is many labels of
    at most a tile's cells: no task holds more of it.
    """
    cells = px.where(F.col("cls") == cls).select(*LINE, "r", "c")
    kinds = dict(cells.dtypes)
    at = lambda c: F.floor(F.col(c) / tile)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["r", "c"], ignore_index=True)
        r, c = part["r"].to_numpy(), part["c"].to_numpy()
        first = run_labels(r, c)
        return part[[*LINE, "r", "c"]].assign(lr=r[first], lc=c[first])

    dealt = cells.withColumns({"tr": at("r"), "tc": at("c")}).groupBy(*LINE, "tr", "tc")
    inside = stage(dealt.applyInPandas(label, f"lake {kinds['lake']}, yr {kinds['yr']}, r {kinds['r']}, c {kinds['c']}, lr {kinds['r']}, lc {kinds['c']}"), "tile-patches")
    edge = lambda c: F.pmod(c, F.lit(tile)).isin(0, tile - 1)
    border = inside.where(edge(F.col("r")) | edge(F.col("c"))).withColumn("label", F.struct(*LINE, "lr", "lc"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    to = border.withColumn("s", F.explode(steps)).select(*LINE, (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"), "r", "c", F.col("label").alias("a"))
    to = to.where((F.floor(F.col("nr") / tile) != at("r")) | (F.floor(F.col("nc") / tile) != at("c")))
    links = to.join(border.select(*LINE, F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("label").alias("b")), [*LINE, "nr", "nc"]).select("a", "b").distinct()
    roots = components(links).select("node.*", F.struct("root.lr", "root.lc").alias("root"))
    labels = inside.groupBy(*LINE, "lr", "lc").agg(F.count("*").alias("n")).join(roots, [*LINE, "lr", "lc"], "left").withColumn("root", F.coalesce("root", F.struct("lr", "lc")))
    if least > 1:
        labels = stage(labels, "patch-labels")
        large = labels.groupBy(*LINE, "root").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
        labels = labels.join(large, [*LINE, "root"])
    out = inside.join(labels.select(*LINE, "lr", "lc", "root"), [*LINE, "lr", "lc"])
    return out.select(*LINE, "r", "c", F.concat_ws(",", "root.lr", "root.lc").alias("patch"))


def patch_table(cells: DataFrame) -> DataFrame:
    """Area and box of each patch."""
    return cells.groupBy(*LINE, "patch").agg(F.count("*").alias("px"), F.round(F.count("*") * PIXEL_HA, 2).alias("ha"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def outline(px: DataFrame, cls: int) -> DataFrame:
    """Unit edges between a class and the rest, and so the perimeter, by lake and year."""
    cells = px.where(F.col("cls") == cls).select(*LINE, "r", "c")
    sides = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    to = cells.withColumn("s", F.explode(sides)).select(*LINE, "r", "c", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    return to.join(cells.select(*LINE, F.col("r").alias("nr"), F.col("c").alias("nc")), [*LINE, "nr", "nc"], "left_anti")


def block_average(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Means over factor x factor blocks; 0 is no data."""
    v = F.when(F.col(value) != 0, F.col(value))
    return px.groupBy(*LINE, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.round(F.coalesce(F.avg(v), F.lit(0.0)), 4).alias(value))


def quality(px: DataFrame, grey: str) -> DataFrame:
    """RMS contrast and entropy of a grey band in 0..255."""
    g = F.col(grey)
    n = px.groupBy(*LINE, F.floor(g).cast("int").alias("level")).agg(F.count("*").alias("k"), F.sum(g).alias("s"), F.sum(g * g).alias("ss"))
    total = Window.partitionBy(*LINE)
    p = F.col("k") / F.sum("k").over(total)
    return n.withColumn("bits", -p * F.log2(p)).groupBy(*LINE).agg(F.round(F.sqrt(F.greatest(F.sum("ss") / F.sum("k") - F.pow(F.sum("s") / F.sum("k"), 2), F.lit(0.0))), 4).alias("contrast"), F.round(F.sum("bits"), 4).alias("entropy"))


def stretched(px: DataFrame, band: str, gamma: float = 0.85) -> DataFrame:
    """Band stretched between its 2nd and 98th percentile."""
    lim = px.groupBy(*LINE).agg(F.percentile(band, F.lit(0.02)).alias("lo"), F.percentile(band, F.lit(0.98)).alias("hi"))
    v = (F.col(band) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return px.join(lim, LINE).select(*LINE, "r", "c", F.round(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), gamma), 4).alias("v"))


def dihedral(px: DataFrame, size: int) -> DataFrame:
    """The eight symmetries of a square patch: cells move, values don't change."""
    n = size - 1
    r, c = F.col("r"), F.col("c")
    maps = [(r, c), (c, n - r), (n - r, n - c), (n - c, r), (r, n - c), (n - r, c), (c, r), (n - c, n - r)]
    every = F.array(*[F.struct(F.lit(k).alias("k"), a.alias("r"), b.alias("c")) for k, (a, b) in enumerate(maps)])
    return px.withColumn("m", F.explode(every)).select(*LINE, F.col("m.k").alias("k"), F.col("m.r").alias("r"), F.col("m.c").alias("c"), "cls")


def bounds(px: DataFrame, margin: int, height: int, width: int) -> DataFrame:
    return px.where("region").groupBy("lake").agg(
        F.greatest(F.min("r") - margin, F.lit(0)).alias("r0"), F.least(F.max("r") + margin, F.lit(height - 1)).alias("r1"), F.greatest(F.min("c") - margin, F.lit(0)).alias("c0"), F.least(F.max("c") + margin, F.lit(width - 1)).alias("c1")
    )


def burned(px: DataFrame, cells: DataFrame, patch_colour: int = 255, alpha: float = 0.5) -> DataFrame:
    """Grey band with patches blended in."""
    on = cells.select(*LINE, "r", "c", F.lit(True).alias("on"))
    g = F.col("grey")
    return px.join(on, [*LINE, "r", "c"], "left").select(*LINE, "r", "c", F.round(F.when(F.col("on"), g * (1 - alpha) + patch_colour * alpha).otherwise(g), 4).alias("v"))
