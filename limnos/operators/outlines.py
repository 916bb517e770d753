"""Outlines of patches of cells: boundary sides, straight segments, rings and their areas."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.zonal import PIXEL_HA

PATCH = ["lake", "yr", "patch"]


def boundary(cells: DataFrame) -> DataFrame:
    """Sides between a cell (lake, yr, patch, r, c) and what is not of its patch.

    A side has a direction (0 right, 1 down, 2 left, 3 up) with the patch on its
    right hand, the grid line it lies on, and its place along that line.
    """
    own = cells.select(*PATCH, "r", "c")
    sides = [(-1, 0, 0), (0, 1, 1), (1, 0, 2), (0, -1, 3)]
    each = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(d).alias("dir")) for dr, dc, d in sides])
    to = own.withColumn("s", F.explode(each)).select(*PATCH, "r", "c", "s.dir", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    open_ = to.join(own.select(*PATCH, F.col("r").alias("nr"), F.col("c").alias("nc")), [*PATCH, "nr", "nc"], "left_anti")
    line = F.when(F.col("dir") == 0, F.col("r")).when(F.col("dir") == 1, F.col("c") + 1).when(F.col("dir") == 2, F.col("r") + 1).otherwise(F.col("c"))
    return open_.select(*PATCH, "dir", line.alias("line"), F.when(F.col("dir") % 2 == 0, F.col("c")).otherwise(F.col("r")).alias("pos"))


def straight(sides: DataFrame) -> DataFrame:
    """Sides that follow each other on a line as one segment (x1, y1)-(x2, y2)."""
    along = Window.partitionBy(*PATCH, "dir", "line").orderBy("pos")
    runs = sides.withColumn("k", F.col("pos") - F.row_number().over(along)).groupBy(*PATCH, "dir", "line", "k").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))
    first, last = (F.when(F.col("dir") < 2, F.col(a)).otherwise(F.col(b)) for a, b in (("lo", "hi"), ("hi", "lo")))
    flat = F.col("dir") % 2 == 0
    at = lambda p: (F.when(flat, p).otherwise(F.col("line")), F.when(flat, F.col("line")).otherwise(p))
    (x1, y1), (x2, y2) = at(first), at(last)
    return runs.select(*PATCH, "dir", x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def outlines(segments: DataFrame) -> DataFrame:
    """Perimeter in cells, corners and WKT of each patch's outline."""
    text = F.format_string("(%d %d, %d %d)", "x1", "y1", "x2", "y2")
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    out = segments.groupBy(*PATCH).agg(F.sum(length).cast("long").alias("perimeter"), F.count("*").alias("corners"), F.array_sort(F.collect_list(text)).alias("parts"))
    return out.select(*PATCH, "perimeter", "corners", F.concat(F.lit("MULTILINESTRING ("), F.concat_ws(", ", "parts"), F.lit(")")).alias("wkt"))


def rings(segments: DataFrame) -> DataFrame:
    """Closed rings (points x, y) of each patch: the outer one runs clockwise on a grid whose rows go down.

    Where two cells of a patch touch at a corner only, the ring turns left, so
    such cells stay in one ring. One patch's corners are a bounded group: a
    patch lies in one raster.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out = defaultdict(list)
        for d, x1, y1, x2, y2 in sorted(zip(rows["dir"], rows["x1"], rows["y1"], rows["x2"], rows["y2"], strict=True)):
            out[x1, y1].append((d, (x2, y2)))
        found = []
        for start in sorted(out):
            while out[start]:
                d, at = out[start].pop(0)
                ring = [start]
                while at != start:
                    ring.append(at)
                    left = [k for k, (turn, _) in enumerate(out[at]) if turn == (d - 1) % 4]
                    d, at = out[at].pop(left[0] if left else 0)
                found.append([[float(x), float(y)] for x, y in [*ring, start]])
        key = [rows[c].iloc[0] for c in PATCH]
        return pd.DataFrame([(*key, k, ring) for k, ring in enumerate(found)], columns=[*PATCH, "ring", "pts"])

    kinds = dict(segments.dtypes)
    return segments.groupBy(*PATCH).applyInPandas(walk, f"lake {kinds['lake']}, yr {kinds['yr']}, patch {kinds['patch']}, ring int, pts array<array<double>>")


def ring_area(pts) -> F.Column:
    """Signed area of a ring by the shoelace formula; holes are negative."""
    here, following = F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts) - 1)
    terms = F.zip_with(here, following, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2


def reconciled(cells: DataFrame) -> DataFrame:
    """Polygons, vector and raster hectares of each lake's layers (``yr`` is the layer) from patches' cells."""
    vector = rings(straight(boundary(cells))).groupBy("lake", "yr").agg(F.count_distinct("patch").alias("polygons"), F.round(F.sum(ring_area(F.col("pts"))) * PIXEL_HA, 2).alias("vector_ha"))
    raster = cells.groupBy("lake", "yr").agg(F.round(F.count("*") * PIXEL_HA, 2).alias("raster_ha"))
    return vector.join(raster, ["lake", "yr"])
