"""Forecast of persistent built-up growth: features, fit, validation, refit and projection."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import spectral as S
from limnos.operators import evaluate, models, panel, raster
from limnos.storage import stage

BANDS = ("blue", "green", "red", "nir", "swir16")
INDICES = ("ndwi", "mndwi", "ndvi", "ndbi")
CHANGES = ("ndvi", "ndbi", "mndwi")
TEXTURES = ("nir", "swir16")
CELL = ["lake", "r", "c"]
#: Columns of features(): channels, changes to the year before, surroundings, history and zones.
FEATURES = (
    *BANDS, *INDICES, *[f"{s}_{b}" for b in TEXTURES for s in ("mean", "std")], *[f"d_{i}" for i in CHANGES],
    "built_share_100m", "built_share_300m", "dist_built_m", "built_years_before", "shore_m", "in_lake", "in_30m", "in_75m", "dist_road_m",
)


def features(grid: DataFrame, roads: DataFrame, height: int, width: int, built_cap: float = 2000.0, road_cap: float = 3000.0) -> DataFrame:
    """FEATURES of every cell and year of a dense grid (bands, scl, cls, zone flags); ``roads`` has cells (r, c).

    Changes are to the calendar year before, 0 where it is missing. Distances
    stop at their caps, which they also have where there is nothing to be near.
    """
    idx = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    base = stage(grid.withColumns({k: v for k, v in idx.items() if k in INDICES}).withColumn("built", F.coalesce(F.col("cls") == S.BUILT, F.lit(False))), "forecast-grid")
    by_year = Window.partitionBy(*CELL).orderBy("yr")
    follows = F.lag("yr").over(by_year) == F.col("yr") - 1
    out = base.withColumns({f"d_{i}": F.when(follows, F.col(i) - F.lag(i).over(by_year)).otherwise(0.0) for i in CHANGES})
    out = out.withColumn("built_years_before", F.coalesce(F.sum(F.col("built").cast("int")).over(by_year.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    key = [*CELL, "yr"]
    for b in TEXTURES:
        out = out.join(raster.texture(base, b, height, width).withColumnsRenamed({"mean": f"mean_{b}", "std": f"std_{b}"}), key)
    for name, radius in (("built_share_100m", 5), ("built_share_300m", 15)):
        out = out.join(raster.built_share(base, radius, height, width).withColumnRenamed("share", name), key)
    out = out.join(raster.distance_to(base, "built", built_cap).withColumnRenamed("distance", "dist_built_m"), key)
    place = base.select(*CELL, "inside").distinct()
    on_road = place.join(roads.distinct().withColumn("road", F.lit(True)), ["r", "c"], "left").withColumn("road", F.coalesce("road", F.lit(False))).withColumn("yr", F.lit(0))
    out = out.join(raster.shoreline(place).withColumnRenamed("shore", "shore_m"), CELL)
    out = out.join(raster.distance_to(on_road, "road", road_cap).select(*CELL, F.col("distance").alias("dist_road_m")), CELL)
    out = out.withColumns({n: F.col(z).cast("double") for n, z in (("in_lake", "inside"), ("in_30m", "ring_30m"), ("in_75m", "ring_75m"))})
    usable = F.col("region") & ~S.cloudy(F.col("scl")) & F.col("cls").isNotNull() & ~F.col("built")
    return out.select(*key, usable.alias("usable"), *[F.round(F.col(f).cast("double"), 6).alias(f) for f in FEATURES])


#: Cells of a lake and year that a forest is fitted on at most, and those that must have become built.
CAP, LEAST = 60_000, 20


def candidates(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Usable cells with whether they were built ``target`` years on, written once for several fits."""
    return stage(rows.where("usable").join(target, ["lake", "r", "c", "yr"]), "forecast-rows")


def fitted(known: DataFrame, years: list[int], trees: int = 200, depth: int = 14, leaf: int = 20):
    """A forest on candidates of these years (CAP a lake and year); fails below LEAST cells that became built."""
    train = panel.capped_sample(known.where(F.col("yr").isin(years)), ["lake", "yr"], ["r", "c"], CAP)
    if train.where("target = 1").count() < LEAST:
        raise ValueError("too few cells became built")
    return models.forest(train.withColumn("cls", F.col("target")), list(FEATURES), trees=trees, depth=depth, leaf=leaf)


def chance() -> F.Column:
    return F.round(vector_to_array("probability")[1], 6)


def validated(known: DataFrame, train_years: list[int], val_year: int) -> DataFrame:
    """Ranking by lake of a year that the forest, fitted on earlier ones, never saw."""
    held = known.where(F.col("yr") == val_year)
    return evaluate.ranking(fitted(known, train_years).transform(held).select("lake", F.col("target").alias("y"), chance().alias("score")), "lake")


def project(model, rows: DataFrame, last_year: int) -> DataFrame:
    """Probability that each usable cell of the last year is built ``ahead`` years later."""
    return model.transform(rows.where(F.col("usable") & (F.col("yr") == last_year))).select("lake", "r", "c", chance().alias("prob"))
