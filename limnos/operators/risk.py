"""Panel risk models from per-lake sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.storage import stage

#: Lakes whose sums are in the driver and in a task at once.
HELD_LAKES = 2000


def coverage(rows: DataFrame, group: str) -> DataFrame:
    """Share of values within their interval and the median width."""
    return rows.groupBy(group).agg(F.round(F.avg(F.col("value").between(F.col("lo"), F.col("hi")).cast("int")), 6).alias("coverage"), F.round(F.median(F.col("hi") - F.col("lo")), 6).alias("width"))


def coverage_of_band(panel: DataFrame, value: str) -> DataFrame:
    """Coverage of a band of one deviation about each lake's mean."""
    w = Window.partitionBy("lake")
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return coverage(panel.select("lake", F.col(value).alias("value"), (m - s).alias("lo"), (m + s).alias("hi")), "lake")


def sufficient(panel: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per lake: n, sums and cross products of (1, features, target), one row a lake."""
    names = ["_one", *features, target]
    rows = panel.withColumn("_one", F.lit(1.0)).dropna(subset=[*features, target])
    return rows.groupBy("lake").agg(F.array(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a in names for b in names]).alias("products"))


#: Of lakes with so many rows each: how many there are, the sums of their products and of the outer products of their first rows.
Totals = dict[float, tuple[float, np.ndarray, np.ndarray]]


def totals(stats: list[np.ndarray]) -> Totals:
    out: Totals = {}
    for s in stats:
        n, products, outer = out.get(s[0, 0], (0.0, 0.0, 0.0))
        out[s[0, 0]] = n + 1, products + s, outer + np.outer(s[0], s[0])
    return out


def without(whole: Totals, *stats: np.ndarray) -> Totals:
    """The totals with some of their lakes taken off."""
    out = dict(whole)
    for s in stats:
        n, products, outer = out[s[0, 0]]
        out[s[0, 0]] = n - 1, products - s, outer - np.outer(s[0], s[0])
    return {m: t for m, t in out.items() if t[0] > 0.5}


def total_products(sums: DataFrame, width: int) -> Totals:
    """The totals of a table of ``sufficient`` rows, added up where they lie: a few numbers for each number of rows that a lake has."""
    size = width * width
    first = F.slice("products", 1, width)
    outer = F.flatten(F.transform(first, lambda x: F.transform(first, lambda y: x * y)))
    long = sums.select(F.col("products")[0].alias("m"), F.posexplode(F.concat("products", outer, F.array(F.lit(1.0)))).alias("at", "v"))
    out: dict[float, np.ndarray] = {}
    for r in long.groupBy("m", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["m"], np.zeros(2 * size + 1))[r["at"]] = r["v"]
    return {m: (v[-1], v[:size].reshape(width, width), v[size:-1].reshape(width, width)) for m, v in out.items()}


def _fit(whole: Totals, p: int, ratio: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, inverse information, residual variance and REML likelihood at a variance ratio.

    A lake's covariance depends on its number of rows alone, so lakes with
    equal numbers are one term, however many there are.
    """
    w, n, logdet = np.zeros((p + 1, p + 1)), 0.0, 0.0
    for m, (lakes, products, outer) in whole.items():
        w = w + products - ratio / (1 + ratio * m) * outer  # V^-1 applied to the cross products
        n, logdet = n + lakes * m, logdet + lakes * math.log1p(ratio * m)
    xx, xy, yy = w[:p, :p], w[:p, p], w[p, p]
    beta = np.linalg.solve(xx, xy)
    sse = max(yy - xy @ beta, 1e-300)
    var = sse / (n - p)
    return beta, np.linalg.inv(xx), var, -0.5 * ((n - p) * (math.log(2 * math.pi * var) + 1) + logdet + np.linalg.slogdet(xx)[1])


def reml(whole: Totals, p: int) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """_fit at the variance ratio of the largest likelihood, and that ratio."""
    lo, hi = -12.0, 8.0
    for _ in range(80):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if _fit(whole, p, math.exp(a))[3] > _fit(whole, p, math.exp(b))[3] else (a, hi)
    ratio = math.exp((lo + hi) / 2)
    return *_fit(whole, p, ratio), ratio


def random_intercept(panel: DataFrame, features: list[str], target: str) -> dict:
    """REML fit of target ~ 1 + features + (1 | lake) from sums over lakes with equal numbers of rows."""
    p = 1 + len(features)
    beta, inverse, var, like, ratio = reml(total_products(sufficient(panel, features, target), p + 1), p)
    se = np.sqrt(np.diag(inverse) * var)
    return {"names": ["intercept", *features], "coef": beta.tolist(), "se": se.tolist(), "group_var": float(ratio * var), "residual_var": float(var), "loglik": float(like)}


def coefficients(spark: SparkSession, fit: dict, z: float = 1.959964) -> DataFrame:
    """A fit's coefficients with standard errors and 95 % intervals, one row each, and both variances."""
    rows = [(n, float(b), float(s), float(b - z * s), float(b + z * s), fit["group_var"], fit["residual_var"]) for n, b, s in zip(fit["names"], fit["coef"], fit["se"], strict=True)]
    return spark.createDataFrame(rows, "name string, coef double, se double, lo double, hi double, group_var double, residual_var double")


def jackknife_plus(panel: DataFrame, features: list[str], target: str, alpha: float = 0.1) -> DataFrame:
    """Jackknife+ intervals of the random-intercept model with whole lakes left out: lake, yr, y, pred, lo, hi.

    Each test lake's row of sums is taken off the totals, and each other lake's
    in turn, so a fit costs the same for any number of lakes. The other lakes
    come in blocks of HELD_LAKES, which is what the driver and a task hold.
    Fixed effects predict, since a test lake's intercept is unknown. An interval
    whose order statistic lies beyond the residuals is open (infinite) on that
    side. Rows with nulls are left out.
    """
    p = 1 + len(features)
    sums = stage(sufficient(panel, features, target), "lake-sums")
    whole = total_products(sums, p + 1)
    kind = panel.schema["lake"].dataType.simpleString()
    lakes = sums.count()
    blocks = max(1, -(-lakes // HELD_LAKES))

    def fits(held: list[tuple], alone: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for test, products in zip(batch["lake"], batch["products"], strict=True):
                    rest = without(whole, np.array(products).reshape(p + 1, p + 1))
                    found = [(test, lake, reml(without(rest, np.array(s).reshape(p + 1, p + 1)), p)[0].tolist()) for lake, s in held if lake != test]
                    if alone:
                        found.append((test, None, reml(rest, p)[0].tolist()))
                    yield pd.DataFrame(found, columns=["test", "held", "beta"]).astype({"held": object})

        return run

    left = None
    tests = sums.repartition(max(1, min(lakes, 1000)), "lake")
    for block in range(blocks):
        held = [(r["lake"], r["products"]) for r in sums.where(F.pmod(F.xxhash64("lake"), F.lit(blocks)) == block).collect()]
        part = tests.mapInPandas(fits(held, block == 0), f"test {kind}, held {kind}, beta array<double>")
        left = part if left is None else left.unionByName(part)
    left = stage(left, "fits-without-lakes")
    rows = panel.dropna(subset=[*features, target]).select("lake", "yr", F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("y"))
    predict = lambda x, b: F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    held = rows.join(left, F.col("lake") == F.col("held")).select("test", "held", F.abs(F.col("y") - predict(F.col("x"), F.col("beta"))).alias("residual"))
    tests = rows.join(left, F.col("lake") == F.col("test")).select("test", "held", "yr", "y", predict(F.col("x"), F.col("beta")).alias("pred"))
    every = tests.join(held, ["test", "held"])
    low = Window.partitionBy("test", "yr").orderBy(F.col("pred") - F.col("residual"))
    high = Window.partitionBy("test", "yr").orderBy(F.col("pred") + F.col("residual"))
    k = every.withColumns({"kl": F.row_number().over(low), "kh": F.row_number().over(high), "n": F.count("*").over(Window.partitionBy("test", "yr"))})
    lo, hi = F.floor(F.lit(alpha) * (F.col("n") + 1)), F.ceil(F.lit(1 - alpha) * (F.col("n") + 1))
    bounds = k.groupBy("test", "yr").agg(F.max(F.when(F.col("kl") == lo, F.col("pred") - F.col("residual"))).alias("lo"), F.max(F.when(F.col("kh") == hi, F.col("pred") + F.col("residual"))).alias("hi"))
    points = tests.where("held is null").select("test", "yr", "y", "pred")
    out = points.join(bounds, ["test", "yr"], "left")
    return out.select(F.col("test").alias("lake"), "yr", "y", "pred", F.coalesce("lo", F.lit(float("-inf"))).alias("lo"), F.coalesce("hi", F.lit(float("inf"))).alias("hi"))
