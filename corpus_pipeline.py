"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact and mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import decontaminate, mixing, near_dup, quality, secrets
from limnos.columns import unused
from limnos.storage import scope, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; all columns stay.

    Null and empty texts get the model's bias as their score. Repeated rows share
    their score. Without labels every score is 0.5, so all documents stay.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    scored = quality.score_quality(docs, model, {c: c for c in docs.columns}, score_col=score)
    return scored.where(F.col(score) >= 0.3).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, a null id last.

    Null and blank texts are one group; of repeated rows one stays.
    """
    return near_dup.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item. Null and empty texts repeat none; repeated rows stay or go together."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their texts replaced by a mark. All rows stay; null texts stay null."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, whole, and how often, for sources weighted 3, 1, 2 in turn.

    Documents without words are not taken. Equal ids are drawn together; a null
    source is a source of its own, the last in order.
    """
    return mixing.mix_sources(docs, whole_rows=True).where(F.col(unused(docs, "copies")) > 0)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mix),
]

#: The first stage is a trained model, so SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each over all that the one before kept.

    A stage's result is written; then what led to it is deleted, and nothing else.
    Nulls in any column, empty and very long texts, ties and repeated rows are
    the stages' to handle, as told there; an empty table stays empty. Columns
    besides those of ``documents`` come out as they are, whatever their names.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        with scope() as steps:
            result = step(spark, docs, sf_dir)
        with scope() as kept:
            docs = stage(result, f"pipeline-{name.replace(' ', '-')}")
        steps.drop(spark)
        if written:
            written.drop(spark)
        written = kept
    return docs
