"""Writers of panels, pixels, vectors and summaries."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.spectral import finite


def write_panel(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pixels(df: DataFrame, path: str) -> None:
    """Pixels by lake and year, so a read of one prunes the rest."""
    df.repartition("lake", "yr").write.mode("overwrite").partitionBy("lake", "yr").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def features(patches: DataFrame, ring: str, props: list[str]) -> DataFrame:
    """One GeoJSON feature a row: id, area_ha (3 digits) and properties; ``ring`` is a ring or an array of rings."""
    nested = str(dict(patches.dtypes)[ring]).count("array") == 3
    body = F.struct(F.lit("Feature").alias("type"), F.struct("id", F.round("area_ha", 3).alias("area_ha"), *props).alias("properties"), F.struct(F.lit("Polygon").alias("type"), (F.col(ring) if nested else F.array(F.col(ring))).alias("coordinates")).alias("geometry"))
    return patches.select(F.to_json(body).alias("value"))


def without_infinities(df: DataFrame) -> DataFrame:
    """Numbers that JSON lacks (NaN, infinities) as null, in nested columns as well."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def number_text(c: Column) -> Column:
    """A finite number's digits, as Java has them: plain from 0.0001 up to 1e16, beyond as 1.5e-07 and 1e+16, where to_json has 4.8E7 early."""
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E-(\d)$", "E-0$2"), r"(\.0)?E(?=\d)", "e+")
    short = F.regexp_replace(short, r"(\.0)?E-", "e-")
    as_is = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    return F.when(as_is, text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def json_text(c: Column, kind: T.DataType) -> Column:
    """JSON of a value with its nulls; numbers as in ``number_text``, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), json_text(c[f.name], f.dataType)) for f in kind]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform(c, lambda x: json_text(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_text(e["key"].cast("string"), T.StringType()), F.lit(":"), json_text(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.map_entries(c), entry)), F.lit("}"))
    else:
        text = F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]\z", "")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def summaries(df: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """One JSON summary a row, with keys of null values kept out of none; the key itself is in it if ``whole``."""
    rest = [c for c in df.columns if whole or c != key]
    kind = T.StructType([df.schema[c] for c in rest])
    return without_infinities(df).select(key, json_text(F.struct(*rest), kind).alias("summary"))


def payload(key: str, **tables: DataFrame) -> DataFrame:
    """A bundle of tables as JSON rows: (part, key, row), so that no bundle has to fit in one row or task."""
    parts = [summaries(df, key, whole=True).select(F.lit(name).alias("part"), key, F.col("summary").alias("row")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
