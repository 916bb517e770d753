"""The library's queries by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limnos.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` follows the views' ``with`` clause (more of it if it starts with a comma)."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"{with_views(*views)}\n{sql}" if views else sql
        return f

    return register


def panel_query(name: str, sql: str | None, f, views: tuple[str, ...] = ("fx_fractions",)) -> None:
    """Register ``f`` of the views' tables."""
    query(name, sql, views)(lambda spark, sf: f(*[view(spark, sf, v) for v in views]))
