"""Areas and shifts of the events raster beyond the south pole."""

from __future__ import annotations

import duckdb
import pytest
from test_beyond_pole import far  # noqa: F401
from test_queries import rows

import __spark_entry__
from cellmosaic import grid_queries
from cellmosaic.functions import ground


def sql(far, statement):  # noqa: F811
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    return rows(con.execute(statement).df())


def test_shifts_are_sqls(spark, far):  # noqa: F811
    assert rows(__spark_entry__.core.QUERIES["ntv2_shift"](spark, far).toPandas()) == sql(far, __spark_entry__.core.SQL["ntv2_shift"])


def test_areas_are_sqls_taken_positive(spark, far):  # noqa: F811
    """SQL's closed form is negative where the raster goes back to the north, so that a cell's pixels cancel out."""
    one = grid_queries._KM2
    assert rows(__spark_entry__.core.QUERIES["ground_area"](spark, far).toPandas()) == sql(far, __spark_entry__.core.SQL["ground_area"].replace(one, f"abs({one})"))


def test_areas_over_poles(spark):
    """Of 5 rows around a pole, the middle one across it; and around the globe, twice its area."""
    at = ground.with_pixel_area(spark.range(5).withColumnRenamed("id", "row"), -89.0, (1.0, 0.4)).orderBy("row").collect()
    want = [spark.range(1).select(sum((ground.zone_area(*map(ground.F.lit, z)) for z in zones), ground.F.lit(0.0))).first()[0] for zones in ([(-89.4, -89.0, 1.0)], [(-89.8, -89.4, 1.0)], [(-90.0, -89.8, 1.0), (-90.0, -89.8, 1.0)], [(-89.8, -89.4, 1.0)], [(-89.4, -89.0, 1.0)])]
    assert [r["area"] for r in at] == pytest.approx(want, rel=1e-9)
    turn = ground.with_pixel_area(spark.range(720).withColumnRenamed("id", "row"), 37.8, (360.0, 0.5)).agg({"area": "sum"}).first()[0]
    assert turn == pytest.approx(2 * 5.1006562172e14, rel=1e-9)
