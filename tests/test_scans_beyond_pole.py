"""Scans of the events raster beyond the south pole, where SQL takes latitudes by their sines."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_beyond_pole import far  # noqa: F401
from test_queries import rows

import __spark_entry__
from cellmosaic.plans.options import ScanOptions
from cellmosaic.sources import geotiff, scan


@pytest.mark.parametrize("name", ["scan_cells", "scan_bands", "scan_formula", "scan_cells_rgss", "merge_states_sql"])
def test_same_as_sql_beyond_the_pole(spark, far, name):  # noqa: F811
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    assert rows(__spark_entry__.core.QUERIES[name](spark, far).toPandas()) == rows(con.execute(__spark_entry__.core.SQL[name]).df())


def test_over_poles(spark, tmp_path):
    """Rows beyond a pole are kept if asked for, in a box too, and go with samples in degrees alone."""
    values = np.arange(1.0, 41.0).reshape(4, 10)
    (tmp_path / "a.tif").write_bytes(geotiff.write_geotiff(values, (10, -89), (1.0, 0.5), tile=16))
    run = lambda **o: scan.scan_cells(spark, str(tmp_path / "a.tif"), ScanOptions(**{"grid": "healpix", "resolutions": (6,)} | o)).agg(F.sum("count"), F.sum("sum")).first()
    assert run() == (20, values[:2].sum()) and run(over_poles=True) == (40, values.sum())
    # at -89.25 and, beyond, at -90.75
    assert run(over_poles=True, bbox=(0.0, -89.5, 40.0, -89.0)) == (20, values[[0, 3]].sum())
    for bad in ({"transfer": "overlay"}, {"transfer": "interpolate"}):
        with pytest.raises(ValueError):
            ScanOptions(over_poles=True, **bad)
    with pytest.raises(ValueError, match="degrees"):
        run(over_poles=True, source_crs=3031)
