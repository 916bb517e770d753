"""Names of helper columns beside a caller's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, with underscores before it if ``df`` or another has such a column."""
    taken = {c.lower() for x in (df, *others) for c in x.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
