"""Confusion tables, metrics, calibration, ranking and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.storage import stage


def confusion(scored: DataFrame, group: str, classes: int = 4) -> DataFrame:
    """Counts by group, truth and prediction; unknown and out-of-range classes are dropped."""
    ok = F.col("truth").between(0, classes - 1) & F.col("pred").between(0, classes - 1)
    return scored.where(ok).groupBy(group, "truth", "pred").agg(F.count("*").alias("n"))


def class_metrics(cm: DataFrame, group: str, classes: int = 4) -> DataFrame:
    """Precision, recall, F1 and IoU of every class of each group, from long counts."""
    rows = cm.select(group, F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    cols = cm.select(group, F.col("pred").alias("cls"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp"))
    s = rows.unionByName(cols).groupBy(group, "cls").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = F.when(F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted")))
    return s.withColumns({"precision": precision, "recall": recall, "f1": F.when(F.col("support") > 0, f1), "iou": ratio(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))})


def summary_metrics(cm: DataFrame, group: str, zero_division: str = "skip") -> DataFrame:
    """Accuracy, macro F1, macro IoU and kappa of each group.

    A class in the truth that is never predicted has no F1; ``skip`` leaves it
    out of the mean, ``zero`` counts it as 0.
    """
    per = class_metrics(cm, group).where(F.col("support") > 0)
    f1 = F.col("f1") if zero_division == "skip" else F.coalesce("f1", F.lit(0.0))
    macro = per.groupBy(group).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.avg("iou"), 6).alias("macro_iou"), F.sum("support").alias("n"), F.sum("tp").alias("hits"))
    chance = class_metrics(cm, group).groupBy(group).agg(F.sum(F.col("support") * F.col("predicted")).alias("chance"))
    po, pe = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return macro.join(chance, group).select(group, F.round(po, 6).alias("accuracy"), "macro_f1", "macro_iou", F.when(pe < 1, F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6)).alias("kappa"), F.col("n").cast("long").alias("n"))


def row_normalised(cm: DataFrame, group: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(group, "truth"))
    return cm.select(group, "truth", "pred", F.round(F.col("n") / F.greatest(total, F.lit(1)), 6).alias("share"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; confidence 0 is in none."""
    b = scored.where("conf > 0").groupBy(F.ceil(F.col("conf") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("conf"))
    total = scored.agg(F.count("*").alias("total"))
    return b.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.max("total"), 6).alias("ece"))


def running_sums(rows: DataFrame, group: str, order: Column, sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (name, column) of ``sums``, name_upto and name_all: sums up to the row in its group's order, and of the whole group.

    Rows are dealt by ranges of (group, order), so a group of any size is in as
    many tasks as it has ranges. The ranges' sums, few, are added up first;
    within a range a window does the rest. ``order`` should tell a group's rows
    apart.
    """
    ranged = stage(rows.repartitionByRange(F.col(group), order).withColumn("range", F.spark_partition_id()), "ranged-rows")
    per = ranged.groupBy(group, "range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(group, "range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    within = Window.partitionBy(group, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = {f"{n}_upto": F.col(f"{n}_before") + F.sum(c).over(within) for n, c in sums.items()}
    return ranged.join(offsets, [group, "range"]).withColumns(upto).drop("range", *[f"{n}_before" for n in sums])


def ranking(scored: DataFrame, group: str) -> DataFrame:
    """ROC AUC (ties half), average precision (step-wise) and the threshold of the best F1, by group.

    Scores are counted first, so running sums are over distinct scores only.
    """
    by_score = scored.groupBy(group, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    c = running_sums(by_score, group, F.desc("score"), {"p": "pos", "n": "neg"}).withColumnsRenamed({"p_upto": "tp", "n_upto": "fp", "p_all": "p", "n_all": "n"})
    c = c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")))
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0) / F.nullif(F.max("p") * F.max("n"), F.lit(0))
    ap = F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("p"), F.lit(0))
    return c.groupBy(group).agg(F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("ap"), F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.round(F.max("f1"), 6).alias("best_f1"))


def order_statistics(values: DataFrame, group: str, value: str, alpha: float) -> DataFrame:
    """The floor(a (n + 1))-th and ceil((1 - a)(n + 1))-th smallest of each group; infinite beyond the ends.

    Equal values are counted first; running counts over ranges then find the two.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    c = running_sums(counted, group, F.asc(value), {"k": "k"})
    at = lambda k: F.max(F.when((F.col("k_upto") >= k) & (F.col("k_upto") - F.col("k") < k), F.col(value)))
    lo, hi = F.floor(F.round(alpha * (F.col("k_all") + 1), 9)), F.ceil(F.round((1 - alpha) * (F.col("k_all") + 1), 9))
    return c.groupBy(group).agg(F.coalesce(at(lo), F.lit(float("-inf"))).alias("lo"), F.coalesce(at(hi), F.lit(float("inf"))).alias("hi"))


def temperature(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Negative log likelihood of each temperature in one pass, best first; logits and truth per row."""
    t = scored.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    scaled = F.transform("logits", lambda x: x / F.col("t"))
    top = F.array_max("scaled")
    nll = top + F.log(F.aggregate("scaled", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("scaled")))) - F.element_at("scaled", F.col("truth").cast("int") + 1)
    return t.withColumn("scaled", scaled).groupBy("t").agg(F.round(F.avg(nll), 6).alias("nll"))


def fitted_temperature(scored: DataFrame, coarse: int = 8) -> DataFrame:
    """The temperature of the least negative log likelihood: over powers of the root of 2, then once around the best of them."""

    def best(grid: DataFrame) -> DataFrame:
        top = F.array_max("logits")
        nll = top / F.col("t") + F.log(F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp((x - F.array_max("logits")) / F.col("t")))) - F.element_at("logits", F.col("truth").cast("int") + 1) / F.col("t")
        per = scored.crossJoin(F.broadcast(grid)).groupBy("t").agg(F.avg(nll).alias("nll"))  # a grid of 17 numbers
        return per.agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("t"), F.min("nll").alias("nll"))

    spark = scored.sparkSession
    steps = F.explode(F.sequence(F.lit(-coarse), F.lit(coarse))).alias("k")
    first = best(spark.range(1).select(steps).select(F.pow(F.lit(2.0), F.col("k") / 2.0).alias("t")))
    around = first.select("t", steps).select((F.col("t") * F.pow(F.lit(2.0), F.col("k") / 16.0)).alias("t"))
    return best(around).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


def wilcoxon(pairs: DataFrame, group: str) -> DataFrame:
    """Two-sided signed-rank test of (a, b) per group: exact for 20 non-zero differences or fewer, else normal.

    The exact null counts the subset sums of the doubled ranks by a dynamic
    programme over an array, so ties need no table.
    """
    d = pairs.select(group, F.round(F.col("a") - F.col("b"), 9).alias("d")).where("d <> 0")
    by_size = Window.partitionBy(group).orderBy(F.abs("d"))
    ties = F.count("*").over(Window.partitionBy(group, F.abs("d")))
    ranked = d.withColumn("rank2", 2 * F.rank().over(by_size) + ties - 1)  # twice the mean rank
    s = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank2")).otherwise(0)).alias("plus2"), F.sum("rank2").alias("all2"), F.sum(F.col("rank2") * F.col("rank2")).alias("squares"), F.collect_list(F.col("rank2").cast("int")).alias("ranks"))
    least = F.least("plus2", F.col("all2") - F.col("plus2"))
    start = F.transform(F.sequence(F.lit(0), F.col("all2").cast("int")), lambda i: (i == 0).cast("double"))
    shifted = lambda acc, r: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - r), F.lit(0.0)))
    counts = F.when(F.col("n") <= 20, F.aggregate("ranks", start, shifted))
    tail = F.aggregate(F.slice(F.col("counts"), 1, least.cast("int") + 1), F.lit(0.0), lambda acc, x: acc + x)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.col("n")))
    z = (least - F.col("all2") / 2) / F.sqrt(F.col("squares") / 4.0)
    return s.withColumn("counts", counts).select(group, "n", (least / 2.0).alias("statistic"), F.round(F.when(F.col("n") <= 20, exact).otherwise(2 * normal_tail(-F.abs(z))), 6).alias("p"))


def normal_tail(z: Column) -> Column:
    """Lower tail of the normal distribution for z <= 0, to 1e-7 (rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def decision(folds: DataFrame, margin: float = 0.02) -> DataFrame:
    """Mean macro F1 of two models, the one recommended (the first unless the second gains the margin), lakes improved."""
    return folds.agg(
        F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("b") - F.avg("a"), 6).alias("gain"),
        F.count_if(F.col("b") > F.col("a")).alias("improved"), F.when(F.avg("b") - F.avg("a") >= margin, "b").otherwise("a").alias("recommended"),
    )


def pooled_and_mean(counts: DataFrame, model: str = "model", split: str = "split", group: str = "lake", pooled: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Metrics of every lake, model and split, and of all lakes together: confusions pooled for ``pooled`` splits, means of the lakes' metrics for others.

    ``counts`` has the model, split, lake, truth, pred and n. One roll-up over
    the lakes gives each lake's confusion and the pooled one.
    """
    rolled = counts.groupBy(model, split, "truth", "pred", group).agg(F.sum("n").alias("n"))
    every = rolled.unionByName(rolled.where(F.col(split).isin(*pooled)).groupBy(model, split, "truth", "pred").agg(F.sum("n").alias("n")).withColumn(group, F.lit(None).cast(counts.schema[group].dataType)))
    keyed = every.withColumn("key", F.struct(model, split, F.coalesce(F.col(group).cast("string"), F.lit("ALL (pooled)")).alias(group)))
    per = stage(summary_metrics(keyed, "key").select("key.*", "accuracy", "macro_f1", "macro_iou", "kappa", "n"), "split-metrics")
    mean = per.where(~F.col(split).isin(*pooled)).groupBy(model, split).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "macro_f1", "macro_iou", "kappa")], F.sum("n").alias("n"))
    return per.unionByName(mean.withColumn(group, F.lit("ALL (mean)")), allowMissingColumns=False)


def fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("model").agg(*[f(F.col("macro_f1")).alias(n) for n, f in (("mean_f1", lambda c: F.round(F.avg(c), 6)), ("min_f1", F.min), ("max_f1", F.max))])
