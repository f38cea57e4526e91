"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lectern.plans import registry


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    c.execute("set timezone = 'UTC'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, folder, duck, name):
    ours, theirs = registry.QUERIES[name](spark, folder).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() >= 0
