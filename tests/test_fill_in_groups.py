"""Polygon fill takes a polygon's cells together, over as many tasks as shuffles have, however small the file of polygons."""

from __future__ import annotations

import pytest

from cellmosaic.functions import wkb
from cellmosaic.operators import polyfill


def _boxes(n):
    out = []
    for k in range(n):
        west, south = -170.3 + k % 5 * 12.7, -60.2 + k * 7 % 5 * 4.3
        out.append((k, bytearray(wkb.polygon([(west, south), (west + 20.0, south), (west + 20.0, south + 15.0), (west, south + 15.0)]))))
    return out


@pytest.mark.parametrize("name, level, levels", [("h3", 3, None), ("h3", 3, 1), ("s2", 5, None), ("s2", 5, 2), ("healpix", 5, None), ("healpix", 5, 1)])
def test_copies_and_rounds_give_the_cells_of_each_polygon(spark, name, level, levels):
    rows = _boxes(12)
    frame = spark.createDataFrame(rows, "key long, wkb binary")
    for mode in ("contains_centroid", "contains_boundary", "covers"):
        got = sorted((r["key"], r["cell"]) for r in polyfill.polygons_to_cells(frame, level, mode, levels=levels, grid=name).collect())
        assert got == sorted((k, c) for k, g in rows for c in polyfill.polygon_cells(bytes(g), level, mode, name).tolist())


def test_one_file_of_polygons_is_filled_by_several_tasks(spark):
    frame = spark.createDataFrame(_boxes(400), "key long, wkb binary").coalesce(1)
    assert polyfill.polygons_to_cells(frame, 3).rdd.getNumPartitions() > 1
