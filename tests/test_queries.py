"""Every query of the library that has SQL, against that SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from limnos.plans import landings, maps, queries, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def key(row):
    return tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a = sorted((tuple(cell(r[c]) for c in columns) for r in ours.collect()), key=key)
    at = [theirs.columns.index(c) for c in columns]
    b = sorted((tuple(cell(r[i]) for i in at) for r in theirs.fetchall()), key=key)
    assert a == b
