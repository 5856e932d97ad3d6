"""The queries that fill suppliers' boxes, over a small file of several copies: SQL's cells, by several tasks."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__

NAMES = ["polyfill_covers", "polyfill_s2_overlapping", "polyfill_s2_contains_boundary", "polyfill_s2_centroid"]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    s = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    s.withColumn("s_suppkey", F.explode(F.array(*[F.col("s_suppkey") + 1000 * k for k in range(6)]))).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_copies_are_filled_by_several_tasks(spark, copies, name):
    got = __spark_entry__.core.QUERIES[name](spark, copies)
    assert got.rdd.getNumPartitions() > 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{copies}/supplier.parquet/*.parquet'")
    assert rows(got.toPandas()) == rows(con.execute(__spark_entry__.core.SQL[name]).df())
