"""Pixel classifiers, group-wise evaluation and forecasts on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators import panel, zonal
from limnos.storage import stage


def forest(train: DataFrame, channels: list[str], trees: int = 300, depth: int = 14, leaf: int = 2, seed: int = 42):
    """Random forest with balanced class weights, fitted on rows with a ``cls``."""
    weights = zonal.class_weights(train.withColumn("_all", F.lit(0)), "_all").select("cls", "weight")
    rows = train.where(F.col("cls").isNotNull()).join(F.broadcast(weights), "cls").withColumn("label", F.col("cls").cast("double"))  # one weight a class
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=channels, outputCol="features", handleInvalid="skip"), rf]).fit(rows)


Scorer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def forest_scorer(channels: list[str], **settings) -> Scorer:
    """A scorer for leave_one_out: fitted on training rows, it gives rows ``pred`` and ``prob``."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = forest(train, channels, **settings)
        return lambda rows: model.transform(rows).select("*", F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("prob"))

    return fit


def rule_scorer(rule: Column) -> Scorer:
    """A scorer that needs no training: a class by an expression, null for no class."""
    return lambda train: lambda rows: rows.select("*", rule.cast("int").alias("pred"), F.lit(None).cast("array<double>").alias("prob"))


def leave_one_out(px: DataFrame, scorers: dict[str, Scorer], cap: int = 200_000, at_once: int = 3) -> DataFrame:
    """Rows of every lake scored by each scorer, none of which saw the lake: scorer, lake, yr, r, c, truth (``cls``), pred, prob.

    One capped, hashed sample is drawn and written, each row with its lake's
    fold; a fold's training rows are the rows of the others. Folds are fitted
    at once, ``at_once`` of them, so that the small jobs of one fill the gaps of
    another. All scorers score the same rows: those with a class.
    """
    known = px.where(F.col("cls").isNotNull())
    lakes = [r["lake"] for r in known.select("lake").distinct().orderBy("lake").collect()]  # one value a lake
    sample = stage(panel.capped_sample(known, ["lake"], ["yr", "r", "c"], cap // max(1, len(lakes) - 1)), "training-sample")

    def fold(lake) -> list[DataFrame]:
        train, test = sample.where(F.col("lake") != lake), known.where(F.col("lake") == lake)
        return [fit(train)(test).select(F.lit(name).alias("scorer"), "lake", "yr", "r", "c", F.col("cls").alias("truth"), "pred", "prob") for name, fit in scorers.items()]

    with ThreadPoolExecutor(at_once) as pool:
        parts = [part for found in pool.map(fold, lakes) for part in found]
    if not parts:
        kinds = dict(px.dtypes)
        return px.sparkSession.createDataFrame([], f"scorer string, lake {kinds['lake']}, yr {kinds['yr']}, r {kinds['r']}, c {kinds['c']}, truth {kinds['cls']}, pred int, prob array<double>")
    return reduce(DataFrame.unionByName, parts)


def importance(model, channels: list[str]) -> list[tuple[str, float]]:
    """The ten most important channels."""
    return sorted(zip(channels, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:10]


def score_patches(px: DataFrame, channels: list[str], score: Callable[[np.ndarray], np.ndarray], size: int, at_once: int = 32, classes: int = 4) -> DataFrame:
    """Logits of patches from a model of the user's: (patches, channels, size, size) to (patches, classes, size, size).

    ``px`` has lake, yr, pr, pc (patch origin), r, c and the channels. A patch's
    pixels are gathered in one row, bounded by its size; the model then takes
    ``at_once`` patches a call, from Arrow batches. A batch's patches overlap,
    so its logits are summed by pixel, with their number, before they leave
    the task: lake, yr, r, c, logits (sums) and hits.
    """
    values = F.array(*[F.col(c).cast("double") for c in channels])
    kinds = dict(px.dtypes)
    patches = px.groupBy("lake", "yr", "pr", "pc").agg(F.collect_list(F.struct("r", "c", values.alias("v"))).alias("cells"))
    ids = ("lake", "yr", "pr", "pc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                cells = pa.concat_arrays([part.column("cells")])
                counts = np.diff(cells.offsets.to_numpy())
                flat = cells.flatten()
                r, c = flat.field("r").to_numpy(), flat.field("c").to_numpy()
                v = flat.field("v").flatten().to_numpy().reshape(-1, len(channels))
                which = np.repeat(np.arange(part.num_rows), counts)
                row, col = r - np.repeat(part.column("pr").to_numpy(), counts), c - np.repeat(part.column("pc").to_numpy(), counts)
                cubes = np.zeros((part.num_rows, len(channels), size, size))
                cubes[which, :, row, col] = v
                out = score(cubes)[which, :, row, col]
                rows = pd.DataFrame({k: np.repeat(part.column(k).to_numpy(), counts) for k in ids[:2]} | {"r": r, "c": c})
                rows[[f"s{k}" for k in range(out.shape[1])]] = out
                rows["hits"] = 1
                sums = rows.groupby(["lake", "yr", "r", "c"], sort=False).sum().reset_index()
                logits = sums[[f"s{k}" for k in range(out.shape[1])]].to_numpy()
                yield pa.RecordBatch.from_arrays([*[pa.array(sums[k]) for k in ("lake", "yr", "r", "c")], pa.array(list(logits)), pa.array(sums["hits"])], ["lake", "yr", "r", "c", "logits", "hits"])

    return patches.mapInArrow(run, f"lake {kinds['lake']}, yr {kinds['yr']}, r {kinds['r']}, c {kinds['c']}, logits array<double>, hits long")


def averaged_logits(scored: DataFrame, classes: int = 4) -> DataFrame:
    """Mean logits of the patches over each pixel."""
    return scored.groupBy("lake", "yr", "r", "c").agg(F.array(*[F.sum(F.col("logits")[k]) / F.sum("hits") for k in range(classes)]).alias("logits"))


def leakage(panel_rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """R2 of boosted trees on rows they saw and on lakes they did not."""
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(panel_rows.fillna(0.0, columns)).select("lake", "features", F.col(target).cast("double").alias("label"))
    gbt = GBTRegressor(maxIter=30, maxDepth=3, seed=7)
    seen = gbt.fit(data).transform(data).withColumn("kind", F.lit("in sample"))
    lakes = [r["lake"] for r in data.select("lake").distinct().orderBy("lake").collect()]
    held = [gbt.fit(data.where(F.col("lake") != x)).transform(data.where(F.col("lake") == x)) for x in lakes]
    every = seen.unionByName(reduce(DataFrame.unionByName, held).withColumn("kind", F.lit("held out")))
    mean = every.groupBy("kind").agg(F.avg("label").alias("mean"))
    return every.join(mean, "kind").groupBy("kind").agg(F.round(1 - F.sum(F.pow(F.col("label") - F.col("prediction"), 2)) / F.sum(F.pow(F.col("label") - F.col("mean"), 2)), 4).alias("r2"))


def stitched(ways: DataFrame) -> DataFrame:
    """Closed rings of each relation from way fragments, chained at their ends; open ones are closed.

    ``ways`` has osm_id, role and pts (array of lon, lat pairs); a relation is a
    bounded group.
    """

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for role, part in group.groupby("role"):
            left = [[tuple(p) for p in pts] for pts in sorted(map(lambda x: [list(p) for p in x], part["pts"]))]
            while left:
                ring = left.pop(0)
                grown = True
                while grown and ring[0] != ring[-1]:
                    grown = False
                    for i, w in enumerate(left):
                        if w[0] == ring[-1] or w[-1] == ring[-1]:
                            ring += (w if w[0] == ring[-1] else w[::-1])[1:]
                            left.pop(i)
                            grown = True
                            break
                if ring[0] != ring[-1]:
                    ring.append(ring[0])
                out.append((group["osm_id"].iloc[0], role, [list(p) for p in ring]))
        return pd.DataFrame(out, columns=["osm_id", "role", "ring"])

    return ways.groupBy("osm_id").applyInPandas(chain, "osm_id long, role string, ring array<array<double>>")
