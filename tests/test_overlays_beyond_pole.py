"""Overlays of rasters that are long, reach a pole or go on over it."""

from __future__ import annotations

from fractions import Fraction

import duckdb
import numpy as np
import pytest
from test_beyond_pole import far  # noqa: F401
from test_queries import rows

import __spark_entry__
from cellmosaic.functions import grids, wkb
from cellmosaic.operators import transfer

ORIGIN, SIZE = (-122.45, 37.80), (0.05, 0.05)


def exact_area(ring, col, row):
    """Of a polygon of fractions in one pixel."""
    for axis, at, low in ((0, col, False), (0, col + 1, True), (1, row, False), (1, row + 1, True)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = (v[axis] <= at if low else v[axis] >= at for v in (p, q))
            if a:
                out.append(p)
            if a != b:
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return abs(sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)), Fraction(0))) / 2


def outline(cell):
    """In pixels, of floating places taken as they are."""
    lon, lat = grids.grid("healpix").planar(np.array([cell]))
    lon = lon + 360 * np.round((-119.95 - lon.mean()) / 360)
    return list(dict.fromkeys((Fraction(a), Fraction(b)) for a, b in zip(((lon[0] - ORIGIN[0]) / SIZE[0]).tolist(), ((ORIGIN[1] - lat[0]) / SIZE[1]).tolist(), strict=True)))


def test_pixels_that_an_outline_does_not_touch_are_none(spark):
    """Far from the raster's corner, differences of areas once left over 1e-12 in pixels beside the outline."""
    ids = [57347, 47295, 47723, 25030]
    got = {}
    for r in transfer.cell_overlaps(spark.createDataFrame([(c,) for c in ids], "cell long"), 6, 100, 2556, ORIGIN, SIZE).collect():
        got.setdefault(r["cell"], {})[r["col"], r["row"]] = r["area"]
    for c in ids:
        ring = outline(c)
        assert all(exact_area(ring, *at) == pytest.approx(a, abs=1e-9) and exact_area(ring, *at) > 1e-13 for at, a in got[c].items())


def test_cells_meet_at_the_pole(spark):
    """A corner on the pole is two, so that cells fill the last rows before it, and once when written."""
    cells = spark.range(4 << 12, 16 << 12).toDF("cell")
    last = transfer.cell_overlaps(cells, 6, 100, 2556, ORIGIN, SIZE).filter("row >= 2554").groupBy("col", "row").sum("area").collect()
    assert len(last) == 200 and all(r[2] == pytest.approx(1, abs=1e-9) for r in last)
    assert [r[0] for r in transfer.cell_overlaps(cells, 6, 100, 2556, ORIGIN, SIZE).filter("row = 2555").select("cell").distinct().collect()] == [57344]
    for name, cell in (("healpix", 57344), ("s2", -6533223325454303232)):
        (ring,), = wkb.read_rings(grids.shapes(np.array([cell]), name)[0])
        assert len(ring) == 6 and (ring[:-1, 1] == -90).sum() == 2


def test_pixels_across_a_pole(spark):
    """Of a pixel that a cell and its image share there is one row, and pixels are whole on both sides."""
    cells = spark.range(4 << 6, 16 << 6).toDF("cell")
    found = transfer.cell_overlaps(cells, 3, 6, 5, (10.0, -89.3), (0.4, 0.4), over_poles=True).collect()
    assert len({(r["cell"], r["col"], r["row"]) for r in found}) == len(found)
    area = np.zeros((5, 6))
    for r in found:
        area[r["row"], r["col"]] += r["area"]
    assert area == pytest.approx(np.ones((5, 6)), abs=1e-9)


@pytest.mark.parametrize("name", ["overlay_cells_cover", "overlay_cells_mass", "overlay_coarse"])
def test_same_as_sql_beyond_the_pole(spark, far, name):  # noqa: F811
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    assert rows(__spark_entry__.core.QUERIES[name](spark, far).toPandas()) == rows(con.execute(__spark_entry__.core.SQL[name]).df())
