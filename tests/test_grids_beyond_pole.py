"""S2 and H3 cells of the events raster beyond the south pole, where SQL takes places by sines and cosines."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Events at the raster's start, at the pole, across it, and once around the globe."""
    folder = tmp_path_factory.mktemp("far")
    e = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 1000")
    e.withColumn("event_id", F.explode(F.array(*[F.col("event_id") + s for s in (0, 255_000, 300_000, 1_000_000)]))).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["s2_scalars", "s2_rollup", "s2_centres", "sql_s2_functions", "h3_assign_continuous", "h3_rollup", "h3_centres", "sql_h3_functions"])
def test_same_as_sql_beyond_the_pole(spark, far, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    assert rows(__spark_entry__.core.QUERIES[name](spark, far).toPandas()) == rows(con.execute(__spark_entry__.core.SQL[name]).df())


def test_outlines_are_sqls_but_for_corners_on_the_pole(spark, far):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    got, want = __spark_entry__.core.QUERIES["s2_outlines"](spark, far).toPandas(), con.execute(__spark_entry__.core.SQL["s2_outlines"]).df()
    assert set(got["cell"]) == set(want["cell"])
    polar = set(want["cell"][want["lat"] == -90])
    assert len(polar) < 5
    assert rows(got[~got["cell"].isin(polar)]) == rows(want[~want["cell"].isin(polar)])
