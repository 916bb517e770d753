"""Lake-year panels: change, growth, readings, folds and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import spectral as S


def by_year():
    return Window.partitionBy("lake").orderBy("yr")


def later():
    return by_year().rowsBetween(1, Window.unboundedFollowing)


def change_from_first(panel: DataFrame, value: str) -> DataFrame:
    """Difference to the first observed year, and in percent where that is above 0."""
    first = F.first(value, ignorenulls=True).over(by_year().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    delta = F.col(value) - first
    return panel.select("lake", "yr", (F.round(delta, 2) + 0.0).alias("delta"), F.when(first > 0, F.round(delta / first * 100, 1) + 0.0).alias("pct"))


def indexed(panel: DataFrame, value: str) -> DataFrame:
    """The first year as 100."""
    first = F.first(value, ignorenulls=True).over(by_year())
    return panel.select("lake", "yr", F.round(F.col(value) / F.nullif(first, F.lit(0.0)) * 100, 3).alias("idx"))


def steps(panel: DataFrame, values: list[str]) -> DataFrame:
    """Each row against the row before it, whatever the years between."""
    return panel.withColumn("from_yr", F.lag("yr").over(by_year())).withColumns({f"d_{v}": F.round(F.col(v) - F.lag(v).over(by_year()), 4) for v in values}).where("from_yr is not null")


def later_max(panel: DataFrame, value: str) -> DataFrame:
    return panel.select("lake", "yr", F.max(value).over(later()).alias("later_max"))


#: The readings of a change, in the order in which they are tried.
READINGS = (
    "no material water loss",
    "ENCROACHMENT SIGNAL - check the building count in the fence",
    "hyacinth spread, not lake loss",
    "drained (bed bare, water returns) - check desilting records",
    "bed bare, no recovery yet - ambiguous, needs documents",
    "transient built spike, does not persist - most likely dry bed misclassified, not construction",
    "water loss, cause unresolved",
)
#: Water lost, built gained, cover gained, and the share of a level that counts as kept.
LOSS, BUILT_GAIN, COVER_GAIN, KEPT = -0.05, 0.02, 0.05, 0.8


def readings(panel: DataFrame) -> DataFrame:
    """Reading of each row's change against the row before: the first of the ordered rules that holds.

    Water recovers if any later row has the kept share of the level before;
    built land persists if any later row has that share of this row's, or none
    is later.
    """
    names = ("water", "veg", "bare", "built")
    rows = panel.withColumns({f"was_{n}": F.lag(n).over(by_year()) for n in names} | {"from_yr": F.lag("yr").over(by_year()), "water_ahead": F.max("water").over(later()), "built_ahead": F.max("built").over(later()), "rows_ahead": F.count("*").over(later())})
    rows = rows.where("from_yr is not null").withColumns({f"d_{n}": F.col(n) - F.col(f"was_{n}") for n in names})
    rows = rows.withColumn("recovers_later", F.coalesce(F.col("water_ahead") >= F.col("was_water") * KEPT, F.lit(False)))
    rows = rows.withColumn("built_persists", (F.col("rows_ahead") == 0) | F.coalesce(F.col("built_ahead") >= F.col("built") * KEPT, F.lit(False)))
    holds = (
        F.col("d_water") >= LOSS,
        (F.col("d_built") > BUILT_GAIN) & F.col("built_persists"),
        F.col("d_veg") > COVER_GAIN,
        (F.col("d_bare") > COVER_GAIN) & F.col("recovers_later"),
        F.col("d_bare") > COVER_GAIN,
        F.col("d_built") > BUILT_GAIN,
        F.lit(True),
    )
    reading = F.coalesce(*[F.when(h, F.lit(r)) for h, r in zip(holds, READINGS, strict=True)])
    return rows.select("lake", "from_yr", "yr", *[F.round(f"d_{n}", 4).alias(f"d_{n}") for n in names], "recovers_later", "built_persists", reading.alias("reading"))


def growth(panel: DataFrame, value: str) -> DataFrame:
    """Log-linear growth a year in percent, null for two rows or fewer, with first and last values."""
    slope = F.regr_slope(F.log1p(F.col(value)), F.col("yr"))
    return panel.where(F.col(value).isNotNull()).groupBy("lake").agg(
        F.count("*").alias("n"), F.min_by(value, "yr").alias("first"), F.max_by(value, "yr").alias("last"), F.when(F.count("*") > 2, F.round((F.exp(slope) - 1) * 100, 1)).alias("growth_pct")
    )


def net_change(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy("lake").agg(F.round(F.max_by(value, "yr") - F.min_by(value, "yr"), 2).alias("net"))


def first_last(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy("lake").agg(F.min("yr").alias("first_yr"), F.min_by(value, "yr").alias("first"), F.max("yr").alias("last_yr"), F.max_by(value, "yr").alias("last"))


def earlier_built(px: DataFrame) -> DataFrame:
    """How many strictly earlier years each cell was built, and whether it is in all later ones."""
    cell = Window.partitionBy("lake", "r", "c").orderBy("yr")
    built = F.coalesce((F.col("cls") == 3).cast("int"), F.lit(0))
    return px.select(
        "lake", "r", "c", "yr", F.coalesce(F.sum(built).over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"),
        F.coalesce(F.min(built).over(cell.rowsBetween(1, Window.unboundedFollowing)), F.lit(1)).alias("always_later"),
    )


def persistent_growth(px: DataFrame, y0: int, y1: int) -> DataFrame:
    """Cells of the region not built in y0 and built in y1 and every later year."""
    built = F.coalesce(F.col("cls") == 3, F.lit(False))
    cells = px.where("region").groupBy("lake", "r", "c").agg(F.max(F.when(F.col("yr") == y0, built.cast("int"))).alias("at0"), F.min(F.when(F.col("yr") >= y1, built.cast("int"))).alias("since"))
    return cells.where("at0 = 0 and since = 1").select("lake", "r", "c")


def index_change(px: DataFrame, value: str) -> DataFrame:
    """Change of an index to the calendar year before; 0 where that year is missing."""
    cell = Window.partitionBy("lake", "r", "c").orderBy("yr")
    return px.select("lake", "r", "c", "yr", F.when(F.lag("yr").over(cell) == F.col("yr") - 1, F.round(F.col(value) - F.lag(value).over(cell), 6)).otherwise(0.0).alias("change"))


def best_per_group(scenes: DataFrame, *group: str) -> DataFrame:
    """The least cloudy scene of each group, the smaller id on ties."""
    w = Window.partitionBy(*group).orderBy("cloud", "id")
    return scenes.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def latest_version(scenes: DataFrame) -> DataFrame:
    """Of scene ids that differ in their last two parts only, the largest."""
    key = F.regexp_extract("scene", r"^(.*)_[^_]*_[^_]*$", 1)
    return scenes.groupBy(key.alias("scene_key")).agg(F.max("scene").alias("scene"), F.count("*").alias("versions"))


def folds(areas: DataFrame) -> DataFrame:
    """Test lake by area, validation the next one round, the rest for training."""
    ranked = areas.withColumn("k", F.row_number().over(Window.orderBy(F.desc("area"), "lake")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    nxt = ranked.select(F.col("k").alias("vk"), F.col("lake").alias("val"))
    rest = ranked.select(F.col("lake").alias("other"))
    pairs = ranked.join(nxt, (F.col("k") + 1) % F.col("n") == F.col("vk")).join(F.broadcast(rest), (F.col("other") != F.col("lake")) & (F.col("other") != F.col("val")))
    return pairs.groupBy(F.col("k").cast("long").alias("fold"), F.col("lake").alias("test"), "val").agg(F.concat_ws(",", F.array_sort(F.collect_list("other"))).alias("train"))


def candidate_dates(scenes: DataFrame, most: int = 6) -> DataFrame:
    """Of the least cloudy dates, the first good one, else that of the least score."""
    w = Window.partitionBy("lake", "yr").orderBy("cloud", "id")
    ranked = scenes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    good = (F.col("cover") > 0.99) & (F.col("bad") < 0.03)
    pick = F.coalesce(F.min_by(F.when(good, F.col("id")), F.when(good, F.col("k"))), F.min_by("id", F.struct("score", "k")))
    return ranked.groupBy("lake", "yr").agg(pick.alias("id"))


def warnings(panel: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Why a lake's results are not to be relied on: one row a lake, with an array of reasons.

    ``built fell``: built pixels of the last year are under a quarter of the
    earlier years' median of 50 or more. ``built F1``: the model's F1 on built
    land there (``scores``: lake, f1_built; null is unknown) is below 0.30.
    """
    last = F.max("yr").over(Window.partitionBy("lake"))
    rows = panel.withColumn("last_yr", last)
    out = rows.groupBy("lake").agg(F.median(F.when(F.col("yr") < F.col("last_yr"), F.col("built_px"))).alias("earlier"), F.max(F.when(F.col("yr") == F.col("last_yr"), F.col("built_px"))).alias("last"))
    f1 = F.lit(None).cast("double")
    if scores is not None:
        out, f1 = out.join(scores.select("lake", "f1_built"), "lake", "left"), F.col("f1_built")
    reasons = F.array(F.when(f1 < 0.30, F.lit("built F1")), F.when((F.col("earlier") >= 50) & (F.col("last") < F.col("earlier") / 4), F.lit("built fell")))
    return out.withColumn("warnings", F.array_compact(reasons)).withColumn("warned", (F.col("earlier") >= 50) & (F.col("last") < F.col("earlier") / 4))


def first_match(queries: DataFrame, lakes: DataFrame) -> DataFrame:
    """The largest lake whose name has each query (id, q) in it, in any case; a blank query matches the largest of all.

    ``lakes`` has lake, name and area. Names meet queries by their runs of three
    letters, so no query is compared with every name; shorter queries are
    compared with each.
    """
    q = queries.withColumn("q", F.lower(F.trim("q")))
    names = lakes.select("lake", "area", F.lower("name").alias("name"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))
    long = q.where(F.length("q") >= 3).withColumn("gram", F.substr("q", F.lit(1), F.lit(3)))
    by_gram = names.withColumn("gram", F.explode(F.array_distinct(grams(F.col("name")))))
    met = long.join(by_gram, "gram").select("id", "q", "lake", "area", "name")
    short = q.where(F.length("q") < 3).withColumn("letters", F.col("q")).join(names.withColumn("letters", F.explode(_starts(F.col("name")))), "letters").select("id", "q", "lake", "area", "name")
    hits = met.unionByName(short).where(F.expr("instr(name, q) > 0"))
    return hits.groupBy("id").agg(F.min_by("lake", F.struct(-F.col("area"), F.col("lake"))).alias("lake"))


def _starts(name: Column) -> Column:
    """The runs of no, one and two letters of a name."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(at, lambda i: F.substr(name, i, F.lit(1))), F.transform(at, lambda i: F.substr(name, i, F.lit(2)))))


def drawn(key: list[str], seed: int = 42):
    """A digest of a row's key, to draw by."""
    return F.md5(F.concat_ws(":", F.lit(seed), *key).cast("binary"))


def capped_sample(rows: DataFrame, group: list[str], key: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows a group, those of the least digests of their key: exact, and the same on every run.

    Groups are counted by the digest's first four hex digits first, so only rows
    up to the one step that the cap falls in are ordered.
    """
    keyed = rows.withColumn("_digest", drawn(key, seed)).withColumn("_step", F.substring("_digest", 1, 4))
    upto = Window.partitionBy(*group).orderBy("_step")
    steps = keyed.groupBy(*group, "_step").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    cuts = steps.where(F.col("_before") < cap).groupBy(*group).agg(F.max("_step").alias("_cut"))
    joined = keyed.join(cuts, group).where(F.col("_step") <= F.col("_cut"))
    w = Window.partitionBy(*group).orderBy("_digest", *key)
    return joined.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).select(*rows.columns)


def shuffled(px: DataFrame, value: str, group: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """A value permuted within its group: the histogram stays, the places don't."""
    w = Window.partitionBy(*group)
    there = px.select(*group, *key, F.row_number().over(w.orderBy(*key)).alias("_k"))
    here = px.select(*group, value, F.row_number().over(w.orderBy(drawn(key, seed), *key)).alias("_k"))
    return there.join(here, [*group, "_k"]).drop("_k")


def rain_trend(rows: DataFrame, x: str, y: str, cutoff: float = 0.40) -> DataFrame:
    """Correlation and fitted line by lake; no trend below the cutoff, nothing for two rows or constant values."""
    usable = (F.count("*") > 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    r = F.corr(x, y)
    out = rows.groupBy("lake").agg(F.count("*").alias("n"), F.when(usable, F.round(r, 4)).alias("r"), F.when(usable, F.round(F.regr_slope(F.col(y), F.col(x)), 6)).alias("slope"), F.when(usable, F.round(F.regr_intercept(F.col(y), F.col(x)), 4)).alias("intercept"))
    return out.withColumn("trend", F.when(F.abs("r") < cutoff, "no trend").when(F.col("r") > 0, "rising").when(F.col("r") < 0, "falling"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations of all columns in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"x{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"x{i}"), 4).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("s")).select("s.*")


def constant_columns(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Whether a column has one value, null included, in every group."""
    per = rows.groupBy(group).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    one = per.agg(*[F.max(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) == 1).alias("constant")) for c in columns])).alias("s")).select("s.*")


def year_matrix(panel: DataFrame, value: str, years: list[int]) -> DataFrame:
    return panel.groupBy("lake").pivot("yr", years).agg(F.first(value)).select("lake", *[F.col(str(y)).alias(f"y{y}") for y in years])


def month_climatology(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rain by year and month, and the mean of those sums by month."""
    by_month = days.groupBy("lake", F.year("d").alias("yr"), F.month("d").alias("m")).agg(F.sum("rain").alias("rain"))
    matrix = by_month.groupBy("lake", "yr").pivot("m", list(range(1, 13))).agg(F.first("rain"))
    return matrix.select("lake", "yr", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]), by_month.groupBy("lake", "m").agg(F.round(F.avg("rain"), 2).alias("mean_rain"))


def forecast_target(px: DataFrame, ahead: int = 3) -> DataFrame:
    """Candidates of the region that are clear, mapped and not built, and whether they are built ``ahead`` years on and ever after."""
    cell = Window.partitionBy("lake", "r", "c").orderBy("yr")
    later = cell.rangeBetween(ahead, Window.unboundedFollowing)
    built = F.coalesce((F.col("cls") == 3).cast("int"), F.lit(0))
    at = F.max(F.when(F.col("yr").isNotNull(), built)).over(cell.rangeBetween(ahead, ahead))
    rows = px.withColumn("then", at).withColumn("always", F.min(built).over(later))
    rows = rows.where(~S.cloudy(F.col("scl")))
    return rows.where("region and cls is not null and cls <> 3 and then is not null").select("lake", "r", "c", "yr", ((F.col("then") == 1) & (F.col("always") == 1)).cast("int").alias("target"))
