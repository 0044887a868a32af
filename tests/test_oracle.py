"""Panel queries against their SQL in DuckDB, by value."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from barloom.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    out = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    key = lambda r: tuple((v is None, str(type(v)), (round(v, 4) if isinstance(v, float) else v) if v is not None else 0) for v in r)
    return sorted(out, key=key)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (a, b)
