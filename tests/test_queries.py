"""Every registered query of the engine against the same result in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, int | float) or hasattr(x, "dtype") and x.dtype.kind in "fiu":
        return round(float(x), 5)
    return str(x)


def rows(frame):
    return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, con, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.queries()) <= set(entry.queries())
