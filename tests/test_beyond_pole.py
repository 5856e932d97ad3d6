"""The events raster beyond the south pole, where SQL takes latitudes by their sines."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Events at the raster's start, at the pole, and once around the globe."""
    folder = tmp_path_factory.mktemp("far")
    e = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 1000")
    start = [0, 255_000, 615_000, 1_000_000]
    e.withColumn("event_id", F.explode(F.array(*[F.col("event_id") + s for s in start]))).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["alpha_mask", "assign_centers_continuous", "categorical_long", "categorical_wide", "cell_filter_pushdown", "cells_source", "cells_source_pushdown", "compact_siblings", "decimals_rounding", "distinct_cells", "geotiff_alpha_band", "geotiff_codecs", "sampling_rgss", "multi_resolution"])
def test_same_as_sql_beyond_the_pole(spark, far, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    assert rows(__spark_entry__.core.QUERIES[name](spark, far).toPandas()) == rows(con.execute(__spark_entry__.core.SQL[name]).df())
