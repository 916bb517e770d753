"""Resampling to another grid spacing, and image quality by 3 x 3 kernels."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.operators.raster import LINE, mirrored


class Grid(NamedTuple):
    """A raster's place: UTM zone, left and upper bounds, cell size and extent in cells."""

    zone: int
    minx: float
    maxy: float
    res: float
    height: int
    width: int
    south: bool = False


def nearest(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Cells split into factor x factor finer ones of the same value (class codes are never averaged)."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = px.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return fine.select(*LINE, (F.col("r") * factor + F.col("i")).cast("int").alias("r"), (F.col("c") * factor + F.col("j")).cast("int").alias("c"), value)


def bilinear(px: DataFrame, value: str, factor: int, height: int, width: int) -> DataFrame:
    """Cells refined ``factor`` times by the four coarse centres around each fine centre.

    0 is no data: it has no weight, and the rest share it. Each coarse cell is
    spread over the fine cells it has weight in, so there is no range join.
    """
    reach = F.sequence(F.lit(-factor), F.lit(2 * factor - 1))

    def weight(fine: Column, coarse: str) -> Column:
        return 1 - F.abs((fine + 0.5) / factor - 0.5 - F.col(coarse))

    near = px.where(F.col(value) != 0).withColumn("i", F.explode(reach)).withColumn("j", F.explode(reach))
    near = near.withColumn("fr", F.col("r") * factor + F.col("i")).withColumn("fc", F.col("c") * factor + F.col("j"))
    near = near.withColumn("wr", weight(F.col("fr"), "r")).withColumn("wc", weight(F.col("fc"), "c"))
    near = near.where((F.col("wr") > 0) & (F.col("wc") > 0) & F.col("fr").between(0, height * factor - 1) & F.col("fc").between(0, width * factor - 1))
    w = F.col("wr") * F.col("wc")
    return near.groupBy(*LINE, F.col("fr").cast("int").alias("r"), F.col("fc").cast("int").alias("c")).agg(F.round(F.sum(w * F.col(value)) / F.sum(w), 4).alias(value))


def sharpness_and_noise(px: DataFrame, grey: str, height: int, width: int) -> DataFrame:
    """Variance of the Laplacian (mirrored border) and the fast noise estimate of a grey band, by raster.

    The noise kernel is the product of (1, -2, 1) along rows and columns, over
    inner cells only.
    """
    across, down = Window.partitionBy(*LINE, "r").orderBy("c"), Window.partitionBy(*LINE, "c").orderBy("r")
    second = lambda v, w: F.lag(v).over(w) - 2 * F.col(v) + F.lead(v).over(w)
    ext = mirrored(px.select(*LINE, "r", "c", F.col(grey).cast("double").alias("v")), 1, height, width)
    k = ext.withColumn("across", second("v", across)).withColumn("down", second("v", down)).withColumn("both", second("across", down))
    k = k.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    inner = F.col("r").between(1, height - 2) & F.col("c").between(1, width - 2)
    scale = math.sqrt(math.pi / 2) / (6 * (width - 2) * (height - 2))
    return k.groupBy(*LINE).agg(F.round(F.var_pop(F.col("across") + F.col("down")), 4).alias("sharpness"), F.round(F.sum(F.when(inner, F.abs("both"))) * scale, 4).alias("noise"))


def reprojected(px: DataFrame, value: str, source: Grid, target: Grid, method: str = "bilinear") -> DataFrame:
    """A band on the target's grid from a raster on a grid of another UTM zone: ``nearest`` for codes, else ``bilinear``.

    Each target cell's centre goes by way of longitude and latitude to the
    source's plane, where the cell that holds it, or the four centres around it,
    meet the source's cells by an equi-join. 0 is no data: it has no weight, the
    others share it, and a target cell without any is 0.
    """
    rows, cols = F.explode(F.sequence(F.lit(0), F.lit(target.height - 1))), F.explode(F.sequence(F.lit(0), F.lit(target.width - 1)))
    rasters = px.select(*LINE).distinct()
    cells = rasters.withColumn("tr", rows).withColumn("tc", cols)
    x, y = geo.centre_of(F.col("tc"), F.col("tr"), F.lit(target.minx), F.lit(target.maxy), target.res)
    lon, lat = geo.lonlat(x, y, F.lit(target.zone), F.lit(target.south))
    east, north = geo.utm(F.col("lon"), F.col("lat"), F.lit(source.zone))
    # the north of the equator counts from 0 in either zone
    north = north + F.when(F.lit(source.south) & (F.col("lat") >= 0), geo.SOUTH).when(F.lit(not source.south) & (F.col("lat") < 0), -geo.SOUTH).otherwise(0.0)
    at = cells.withColumns({"lon": lon, "lat": lat}).withColumn("fc", (east - source.minx) / source.res).withColumn("fr", (source.maxy - north) / source.res)
    if method == "nearest":
        around = at.withColumns({"r": F.floor("fr"), "c": F.floor("fc"), "w": F.lit(1.0)})
    else:
        steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        around = at.withColumn("s", steps).withColumn("r", F.floor(F.col("fr") - 0.5) + F.col("s.i")).withColumn("c", F.floor(F.col("fc") - 0.5) + F.col("s.j"))
        around = around.withColumn("w", (1 - F.abs(F.col("fr") - 0.5 - F.col("r"))) * (1 - F.abs(F.col("fc") - 0.5 - F.col("c"))))
    around = around.select(*LINE, "tr", "tc", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "w")
    known = px.where(F.col(value) != 0).select(*LINE, "r", "c", F.col(value).cast("double").alias("v"))
    met = around.join(known, [*LINE, "r", "c"], "left")
    weight = F.when(F.col("v").isNotNull(), F.col("w"))
    out = F.sum(weight * F.col("v")) / F.nullif(F.sum(weight), F.lit(0.0))
    return met.groupBy(*LINE, F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.round(F.coalesce(out, F.lit(0.0)), 4).alias(value))
