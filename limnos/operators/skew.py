"""Equi-joins on keys of which one may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.columns import unused

#: A key with more than one in so many rows is hot; so there are fewer hot keys than this.
SHARE = 200
#: Keys with fewer rows are no burden to a task, whatever their share.
FLOOR = 1000
#: Tasks that a hot key's rows are dealt to.
PARTS = 32


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, whose keys are distinct, by ``key``; ``how`` is inner or left.

    ``many`` should come from a written table, as its keys are counted first.
    The rows of the SHARE most frequent keys with more than FLOOR rows are dealt
    to PARTS salts, and that key's row of ``few`` is repeated for each. So all
    keys with more than one row in SHARE are dealt, and no more than SHARE keys
    go by way of the driver at any size; where none is, this is the plain join.
    Rows and columns are those of the plain join: null keys meet nothing,
    repeated rows stay.
    """
    salt, hot = unused(many, "salt", few), unused(many, "hot", few)
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > FLOOR)
    found = counts.orderBy(F.desc("n")).limit(SHARE).select(key).collect()
    if not found:
        return many.join(few, key, how)
    keys = F.broadcast(many.sparkSession.createDataFrame(found, many.select(key).schema).withColumn(hot, F.lit(True)))
    others = [c for c in many.columns if c != key]
    dealt = F.when(F.col(hot), F.pmod(F.xxhash64(*others), F.lit(PARTS)).cast("int")).otherwise(0)
    salts = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(keys, key, "left").withColumn(salt, dealt).drop(hot)
    right = few.join(keys, key, "left").withColumn(salt, F.explode(salts)).drop(hot)
    return left.join(right, [key, salt], how).drop(salt)
