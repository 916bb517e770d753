"""Zonal aggregates of pixels by lake and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import spectral as S

PIXEL_HA = 0.04
ZONE_KEY = ["lake", "r", "c"]


def zoned(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Pixels of the zones' cells; Spark broadcasts the zones when they are small."""
    return pixels.join(zones, ZONE_KEY)


def n_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Share of rows, null where there is nothing to share."""
    return F.round(F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0)), digits)


def lake_areas(pixels: DataFrame, zones: DataFrame, least_valid: float = 0.5) -> DataFrame:
    """Water, vegetation and other hectares of every lake-year that is clear enough."""
    idx = S.indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir16"))
    px = zoned(pixels, zones).withColumns(idx).withColumn("clear", ~S.cloudy(F.col("scl")))
    px = px.withColumn("wet", F.col("clear") & (F.col("mndwi") > 0)).withColumn("leafy", F.col("clear") & (F.col("ndvi") > 0.30) & (F.col("mndwi") <= 0))
    size = zones.where("inside").groupBy("lake").agg(F.count("*").alias("ref_px"))
    ins, col, ok = F.col("inside"), F.col("collar"), F.col("clear")
    out = px.groupBy("lake", "yr").agg(
        n_if(ins & ok).alias("valid_px"),
        n_if(ins & F.col("wet")).alias("water_px"),
        n_if(ins & F.col("leafy")).alias("veg_px"),
        n_if(ins & (F.col("scl") == 6)).alias("scl_px"),
        share(F.col("wet"), col & ok).alias("collar_water_frac"),
        share(F.col("leafy"), col & ok).alias("collar_veg_frac"),
        *[F.round(F.avg(F.when(ins & ok, F.col(i))), 4).alias(f"mean_{i}") for i in ("ndwi", "mndwi", "ndvi")],
    )
    out = out.join(size, "lake").where(F.col("valid_px") >= F.col("ref_px") * least_valid)
    ha = lambda px: F.round(px * F.lit(PIXEL_HA), 2)
    return out.select(
        "lake", "yr", ha(F.col("ref_px")).alias("ref_ha"), ha(F.col("water_px")).alias("water_ha"), ha(F.col("veg_px")).alias("veg_ha"),
        ha(F.col("valid_px") - F.col("water_px") - F.col("veg_px")).alias("other_ha"), F.round(F.col("water_px") / F.col("valid_px"), 4).alias("water_frac"),
        "mean_ndwi", "mean_mndwi", "mean_ndvi", "collar_water_frac", "collar_veg_frac", ha(F.col("scl_px")).alias("scl_water_ha"),
    )


def composition(px: DataFrame) -> DataFrame:
    """Class shares of the footprint and built shares of the rings; ignored pixels count nowhere."""
    known = F.col("cls").isNotNull()
    names = ("water", "vegetation", "bare", "built")
    parts = [share(F.col("cls") == k, F.col("inside") & known).alias(f"{n}_frac") for k, n in enumerate(names)]
    rings = [share(F.col("cls") == S.BUILT, F.col(z) & known).alias(f"built_{z}") for z in ("ring_30m", "ring_75m")]
    return px.groupBy("lake", "yr").agg(*parts, *rings)


def class_hectares(px: DataFrame) -> DataFrame:
    """Hectares of each class in the footprint and of built land in the nested rings."""
    ha = lambda c: F.round(F.count_if(c) * PIXEL_HA, 2)
    names = ("water", "vegetation", "bare", "built")
    return px.groupBy("lake", "yr").agg(
        *[ha(F.col("inside") & (F.col("cls") == k)).alias(f"{n}_ha") for k, n in enumerate(names)], *[ha(F.col(z) & (F.col("cls") == S.BUILT)).alias(f"built_{z}_ha") for z in ("ring_30m", "ring_75m")]
    )


def zone_split(px: DataFrame, mask: Column) -> DataFrame:
    """Hectares of a mask inside, in the nested rings and beyond them."""
    ha = lambda c: F.round(F.count_if(mask & c) * PIXEL_HA, 2)
    return px.groupBy("lake").agg(
        ha(F.col("inside")).alias("inside_ha"), ha(F.col("ring_30m")).alias("ring_30m_ha"), ha(F.col("ring_75m")).alias("ring_75m_ha"),
        ha(F.col("region") & ~F.col("inside") & ~F.col("ring_75m")).alias("beyond_ha"),
    )


def class_weights(px: DataFrame, group: str = "lake") -> DataFrame:
    """Class histogram and inverse-frequency weights with mean 1, per group."""
    n = px.where(F.col("cls").isNotNull()).groupBy(group, "cls").agg(F.count("*").alias("n"))
    raw = F.lit(1.0) / F.greatest(F.col("n"), F.lit(1))
    return n.withColumn("raw", raw).select(group, "cls", "n", F.round(F.col("raw") / F.avg("raw").over(Window.partitionBy(group)), 6).alias("weight"))


def label_qa(px: DataFrame) -> DataFrame:
    """Labelled, regional, cloudy and conflicting pixels of each year."""
    label = S.seed_label(F.col("scl"), F.col("buildings"), F.col("region"))
    px = px.withColumn("label", label)
    return px.groupBy("yr").agg(
        n_if(F.col("label").isNotNull()).alias("labelled_px"), n_if(F.col("region")).alias("region_px"), n_if(F.col("region") & S.cloudy(F.col("scl"))).alias("cloud_px"),
        n_if(F.col("region") & S.building_conflict(F.col("scl"), F.col("buildings"))).alias("conflicts"),
        *[n_if(F.col("label") == k).alias(f"n_{n}") for k, n in enumerate(("water", "vegetation", "bare", "built"))],
    )


def external_sums(px: DataFrame, zones: tuple[str, ...]) -> DataFrame:
    """Long table of an external layer's fractional counts and areas present, by lake, zone and year."""
    long = px.select("lake", "yr", "presence", "fraction", F.explode(F.array(*[F.when(F.col(z), F.lit(z)) for z in zones])).alias("zone")).where("zone is not null")
    return long.groupBy("lake", "zone", "yr").agg(
        F.round(F.coalesce(F.sum("fraction"), F.lit(0.0)), 1).alias("buildings"), F.round(F.count_if(F.col("presence") >= 0.5) * PIXEL_HA, 3).alias("built_ha"), F.round(F.count("*") * PIXEL_HA, 2).alias("zone_ha")
    )


def cross_check(px: DataFrame, classes: int = 9) -> DataFrame:
    """Shares of an external layer's classes, agreement with ours, and flooded vegetation (3) where we see vegetation."""
    mapped = S.recoded(F.col("dw"), S.EXTERNAL_CLASS)
    px = px.where("inside").withColumn("theirs", mapped)
    both = F.col("theirs").isNotNull() & F.col("cls").isNotNull()
    return px.groupBy("lake", "yr").agg(
        *[F.round(F.avg((F.col("dw") == k).cast("int")), 4).alias(f"dw_{k}_frac") for k in range(classes)],
        share(F.col("theirs") == F.col("cls"), both).alias("agreement"),
        share(F.col("dw") == 3, F.col("cls") == S.VEGETATION).alias("flooded_of_our_veg"),
    )


def observed_water(px: DataFrame) -> DataFrame:
    """Surface-water shares over observed pixels (class above 0) on both sides."""
    seen = F.col("gsw") > 0
    n = F.greatest(F.count_if(seen), F.lit(1))
    return px.where("inside").groupBy("lake", "yr").agg(
        F.round(F.count_if(F.col("gsw") == 3) / n, 4).alias("permanent_frac"), F.round(F.count_if(F.col("gsw") >= 2) / n, 4).alias("any_frac"),
        F.round(F.count_if(seen & (F.col("cls") == 0)) / n, 4).alias("ours_water_frac"), F.round(F.avg("occurrence"), 4).alias("mean_occurrence"),
    )


def pivoted(long: DataFrame, zones: list[str], measures: list[str]) -> DataFrame:
    """One row a lake-year, columns ob_{measure}_{zone}."""
    wide = long.groupBy("lake", "yr").pivot("zone", zones).agg(*[F.first(m).alias(m) for m in measures])
    return wide.select("lake", "yr", *[F.col(f"{z}_{m}").alias(f"ob_{m}_{z}") for z in zones for m in measures])


def preflight(long: DataFrame) -> DataFrame:
    return long.groupBy("lake").agg(F.max("buildings").alias("max_buildings")).withColumn("passes", F.col("max_buildings") > 1)


def signatures(px: DataFrame, bands: list[str], least: int = 50) -> DataFrame:
    """Mean and quartiles of each band by class, for classes with enough pixels."""
    out = px.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.count("*").alias("n"), *[F.round(F.avg(b), 4).alias(f"mean_{b}") for b in bands], *[F.round(F.percentile(b, F.lit(q)), 4).alias(f"p{int(q * 100)}_{b}") for b in bands for q in (0.25, 0.75)]
    )
    return out.where(F.col("n") >= least)


def separability(px: DataFrame, index: str, reference: Column) -> DataFrame:
    """True and false positive rates of an index at 0 and its distance between reference and rest."""
    v, hit = F.col(index), F.col(index) > 0
    m = lambda c: F.avg(F.when(c, v))
    s = lambda c: F.stddev_pop(F.when(c, v))
    spread = F.sqrt(F.pow(s(reference), 2) + F.pow(s(~reference), 2))
    return px.groupBy("yr").agg(
        F.round(F.avg(F.when(reference, hit.cast("int"))), 4).alias("tpr"), F.round(F.avg(F.when(~reference, hit.cast("int"))), 4).alias("fpr"),
        F.round(F.abs(m(reference) - m(~reference)) / F.nullif(spread, F.lit(0.0)), 4).alias("distance"),
    )


def histogram(px: DataFrame, index: str, bins: int = 120) -> DataFrame:
    """Counts of an index in equal bins over [-1, 1], the last one closed."""
    b = F.least(F.floor((F.col(index) + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    return px.groupBy("yr", b.alias("bin")).agg(F.count("*").alias("n"))


def change_counts(first: DataFrame, last: DataFrame) -> DataFrame:
    """Stable, lost and gained water of cells that are clear in both years, in hectares."""
    a, b = F.col("a.wet"), F.col("b.wet")
    both = first.alias("a").join(last.alias("b"), ZONE_KEY).where("a.clear and b.clear and a.inside")
    ha = lambda c: F.round(F.count_if(c) * PIXEL_HA, 2)
    return both.groupBy("lake").agg(ha(a & b).alias("stable_ha"), ha(a & ~b).alias("lost_ha"), ha(~a & b).alias("gained_ha"))


def point_density(points: DataFrame, box: tuple[float, float, float, float], nx: int = 110, ny: int = 92) -> DataFrame:
    """Points in each cell of a box (minx, miny, maxx, maxy; borders included, last bins closed), and the 99th percentile of the filled cells."""
    minx, miny, maxx, maxy = box
    bin_ = lambda v, lo, hi, n: F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")
    inside = points.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))
    cells = inside.groupBy(bin_(F.col("x"), minx, maxx, nx).alias("i"), bin_(F.col("y"), miny, maxy, ny).alias("j")).agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.round(F.percentile("n", F.lit(0.99)), 4).alias("p99"))))


def agreement(px: DataFrame, other: str) -> DataFrame:
    """Map-to-map agreement in the region: mean of the yearly means."""
    yearly = px.where(F.col("region") & F.col("cls").isNotNull() & F.col(other).isNotNull()).groupBy("lake", "yr").agg(F.avg((F.col("cls") == F.col(other)).cast("int")).alias("same"))
    return yearly.groupBy("lake").agg(F.round(F.avg("same"), 6).alias("agreement"))


def scene_scores(px: DataFrame) -> DataFrame:
    """Cloud share plus uncovered share over lake and collar, by scene."""
    bad, shown = S.cloudy(F.col("scl")).cast("int"), (F.col("scl") != 0).cast("int")
    return px.where("region").groupBy("lake", "yr").agg(F.round(F.avg(bad), 6).alias("bad"), F.round(F.avg(shown), 6).alias("cover")).withColumn("score", F.round(F.col("bad") + (1 - F.col("cover")), 6))


def grid_coverage(zones: DataFrame, footprint: DataFrame, least: float = 0.98) -> DataFrame:
    """Footprint on the grid against the whole footprint, and whether too little of it is."""
    on = zones.where("inside").groupBy("lake").agg(F.round(F.count("*") * PIXEL_HA, 2).alias("on_grid_ha"))
    return on.join(footprint, "lake").withColumn("flagged", F.col("on_grid_ha") < F.col("footprint_ha") * least)
