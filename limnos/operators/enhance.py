"""Band enhancement: bilateral smoothing, contrast by tiles, sharpening. The forecasts' source measured it as harmful; it is here to be compared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.raster import LINE, mirrored

#: Reflectance that 1 stands for.
LIMIT = 0.6
LEVELS = 65536


def _around(px: DataFrame, value: str, radius: int) -> DataFrame:
    """The (2 radius + 1) squared values around each cell, row by row, as an array; cells by lines, never whole rasters."""
    across, down = Window.partitionBy(*LINE, "r").orderBy("c"), Window.partitionBy(*LINE, "c").orderBy("r")
    row = F.array(*[F.lag(value, -k).over(across) for k in range(-radius, radius + 1)])
    square = F.flatten(F.array(*[F.lag("_row", -k).over(down) for k in range(-radius, radius + 1)]))
    return px.withColumn("_row", row).withColumn("around", square).drop("_row")


def _within(px: DataFrame, height: int, width: int) -> DataFrame:
    return px.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def bilateral(px: DataFrame, value: str, height: int, width: int, radius: int = 2, colour: float = 0.04, space: float = 1.5) -> DataFrame:
    """Means of the cells within ``radius``, weighted by their distance and by how like the middle they are; the border is mirrored."""
    ext = _within(_around(mirrored(px.select(*LINE, "r", "c", F.col(value).alias("v")), radius, height, width), "v", radius), height, width)
    places = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    near = F.array(*[F.lit(math.exp(-(i * i + j * j) / (2 * space * space)) if i * i + j * j <= radius * radius else 0.0) for i, j in places])
    weights = F.zip_with("around", near, lambda x, w: w * F.exp(-F.pow(x - F.col("v"), 2) / (2 * colour * colour)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    out = ext.withColumn("w", weights)
    return out.select(*LINE, "r", "c", (total(F.zip_with("around", "w", lambda x, w: x * w)) / total("w")).alias(value))


def blurred(px: DataFrame, value: str, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """A Gaussian blur, along rows and then along columns; the border is mirrored."""
    radius = round(4 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    across, down = Window.partitionBy(*LINE, "r").orderBy("c"), Window.partitionBy(*LINE, "c").orderBy("r")
    along = lambda v, w: sum((F.lag(v, -k).over(w) * (x / sum(kernel)) for k, x in zip(range(-radius, radius + 1), kernel, strict=True)), F.lit(0.0))
    ext = mirrored(px.select(*LINE, "r", "c", F.col(value).alias("v")), radius, height, width)
    return _within(ext.withColumn("v", along("v", across)).withColumn("v", along("v", down)), height, width).select(*LINE, "r", "c", F.col("v").alias(value))


def equalised(px: DataFrame, level: str, height: int, width: int, tile: int = 64, clip: float = 2.0) -> DataFrame:
    """Levels 0..65535 by contrast-limited equalisation of tiles, the four tables around each cell blended.

    A tile's histogram is counted, clipped, and what was clipped spread over all
    levels; its running sums, scaled, are the tile's table. A cell looks its
    level up in four tables: lookups and counts of one tile are ordered by level
    together, so a table is never written out. A tile is a bounded group.
    """
    rows, cols = max(1, round(height / tile)), max(1, round(width / tile))
    even = height % rows == 0 and width % cols == 0
    tall, wide = (height, width) if even else (height + rows - height % rows, width + cols - width % cols)
    th, tw = tall // rows, wide // cols
    grid = px.select(*LINE, "r", "c", F.col(level).cast("long").alias("level"))
    edge = max(tall - height, wide - width)
    padded = grid if even else mirrored(grid, edge, height, width).where(F.col("r").between(0, tall - 1) & F.col("c").between(0, wide - 1))
    counts = padded.groupBy(*LINE, F.floor(F.col("r") / th).alias("ty"), F.floor(F.col("c") / tw).alias("tx"), "level").agg(F.count("*").alias("n"))
    limit = max(int(clip * th * tw / LEVELS), 1)

    def sides(at: str, size: int, tiles: int) -> Column:
        place = F.col(at) / size - 0.5
        low = F.floor(place)
        bound = lambda k: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), k))
        return F.array(F.struct(bound(low).alias("t"), (1 - (place - low)).alias("w")), F.struct(bound(low + 1).alias("t"), (place - low).alias("w")))

    asked = grid.withColumn("y", F.explode(sides("r", th, rows))).withColumn("x", F.explode(sides("c", tw, cols)))
    asked = asked.select(*LINE, F.col("y.t").alias("ty"), F.col("x.t").alias("tx"), "level", F.lit(0).cast("long").alias("n"), "r", "c", (F.col("y.w") * F.col("x.w")).alias("w"))
    both = counts.select("*", F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("c"), F.lit(None).cast("double").alias("w")).unionByName(asked)
    of_tile = Window.partitionBy(*LINE, "ty", "tx")
    upto = of_tile.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.least("n", F.lit(limit))
    both = both.withColumns({"below": F.sum(kept).over(upto), "cut": F.sum(F.col("n") - kept).over(of_tile)}).where("r is not null")
    each = F.floor(F.col("cut") / LEVELS)
    rest = F.col("cut") - each * LEVELS
    step = F.greatest(F.floor(LEVELS / F.nullif(rest, F.lit(0))), F.lit(1))
    spread = each * (F.col("level") + 1) + F.coalesce(F.least(rest, F.floor(F.col("level") / step) + 1), F.lit(0))
    table = F.least(F.rint((F.col("below") + spread) * ((LEVELS - 1) / (th * tw))), F.lit(float(LEVELS - 1)))
    return both.groupBy(*LINE, "r", "c").agg(F.rint(F.sum(F.col("w") * table)).cast("long").alias(level))


def enhanced(px: DataFrame, band: str, height: int, width: int, tile: int = 64, clip: float = 2.0, amount: float = 0.6) -> DataFrame:
    """A reflectance band of dense rasters smoothed, equalised by tiles and sharpened; no data (0 or less) stays 0."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x = px.select(*LINE, "r", "c", (F.greatest(F.lit(0.0), F.least(F.lit(LIMIT), F.col(band).cast("double"))) / LIMIT).alias("x"))
    smooth = bilateral(x, "x", height, width).withColumn("level", F.floor(unit(F.col("x")) * (LEVELS - 1)).cast("long"))
    equal = equalised(smooth, "level", height, width, tile, clip).select(*LINE, "r", "c", (F.col("level") / (LEVELS - 1)).alias("x"))
    soft = blurred(equal, "x", height, width).withColumnRenamed("x", "soft")
    out = equal.join(soft, [*LINE, "r", "c"]).join(px.select(*LINE, "r", "c", F.col(band).alias("raw")), [*LINE, "r", "c"])
    sharp = unit(F.col("x") + amount * (F.col("x") - F.col("soft"))) * LIMIT
    return out.select(*LINE, "r", "c", F.round(F.when(F.col("raw") > 0, sharp).otherwise(0.0), 6).alias(band))
