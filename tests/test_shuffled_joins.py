"""Joins of what cells are exploded into with pixels are shuffled: their estimated size leaves out the explosion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellmosaic.operators import transfer

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["interpolate_nearest", "interpolate_bilinear", "interpolate_bicubic", "interpolate_lanczos", "overlay_weighted", "overlay_unweighted", "overlay_mass_preserve", "overlay_coverage", "overlay_cells_mass"])
def test_nothing_exploded_is_broadcast(spark, name):
    plan = _plan(__spark_entry__.core.QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_shares_of_a_pixel_that_cells_share(spark):
    parts = spark.createDataFrame([(1, 0, 0, 0.5), (2, 0, 0, 0.25), (2, 1, 0, 1.0)], "cell long, col long, row long, area double")
    weighed = transfer.overlay_weights(parts, mass_preserve=True)
    assert "Broadcast" not in _plan(weighed)
    assert {(r.cell, r.col): r.weight for r in weighed.collect()} == {(1, 0): 0.5 / 0.75, (2, 0): 0.25 / 0.75, (2, 1): 1.0}


def test_interpolation_weighs_pixels_given_twice(spark):
    pixels = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (1, 0, 5.0)], "col long, row long, value double")
    centre = spark.createDataFrame([(7, 1.0, -0.5)], "cell long, lon double, lat double")
    found = transfer.interpolated(centre, pixels, 2, 1, (0.0, 0.0), (1.0, 1.0), "bilinear").select(F.round("value", 9)).first()[0]
    assert found == 3.0  # the mean of 1, 3 and 5, each weighing a half
