"""Each query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {k: v for k, v in __spark_entry__.core.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("" if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(__spark_entry__.core.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
