"""A stream from north to south: each cell once, and a state that holds what the horizon crosses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import grids
from cellmosaic.operators import continuous
from cellmosaic.streaming import horizon


def stream(spark, folder, bands, end=True, disorder=0.0):
    import time

    for rows in bands:
        spark.createDataFrame(rows, "lon double, lat double, value double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    if end:
        horizon.end_of_raster(spark, disorder).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("lon double, lat double, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def bands(seed=1, n=6):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        lat = np.sort(rng.uniform(60 - 10 * (k + 1), 60 - 10 * k, 400))[::-1]
        out.append([(float(a), float(b), float(v)) for a, b, v in zip(rng.uniform(0, 8, 400), lat, rng.normal(1e6, 3, 400), strict=True)])
    out[1][3] = (out[1][3][0], out[1][3][1], None)
    return out


@pytest.mark.parametrize("grid, level", [("healpix", 6), ("s2", 7), ("h3", 3)])
def test_each_cell_once_and_a_bounded_state(spark, tmp_path, grid, level):
    parts = bands()
    progress = horizon.run(stream(spark, str(tmp_path / "in"), parts), grid, level, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    rows = spark.createDataFrame([r for p in parts for r in p], "lon double, lat double, value double")
    at = rows.withColumn("cell", grids.grid(grid).lonlat_to_cell(F.col("lon"), F.col("lat"), level))
    want = {r["cell"]: r for r in continuous.unit_statistics(at, ["cell"]).collect()}
    assert len(got) == len(want) == len({r["cell"] for r in got})
    for r in got:
        assert all(r[k] == pytest.approx(want[r["cell"]][k], rel=1e-7) for k in ("count", "sum", "mean", "stddev", "min", "max"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) < 0.6 * len(want) and held[-1] == 0


def test_what_is_not_passed_is_kept(spark, tmp_path):
    """Without an end, cells that the horizon hasn't passed stay; a later run with the rest gives them out."""
    parts = bands(2)
    source = stream(spark, str(tmp_path / "in"), parts[:3], end=False)
    horizon.run(source, "healpix", 6, str(tmp_path / "out"), str(tmp_path / "cp"))
    first = {r["cell"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    own = grids.grid("healpix")
    assert first and all(horizon.south_bound("healpix", c) >= 30 - 1e-6 for c in first)
    source = stream(spark, str(tmp_path / "in"), parts[3:])
    horizon.run(source, "healpix", 6, str(tmp_path / "out"), str(tmp_path / "cp"))
    every = [r["cell"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    lon, lat = (np.array([r[k] for p in parts for r in p]) for k in (0, 1))
    assert len(every) == len(set(every)) and set(every) == set(own.cells(lon, lat, 6).tolist())


def test_disorder_and_late_pixels(spark, tmp_path):
    ordered = bands(3, 4)
    mixed = [ordered[1], ordered[0], ordered[2], ordered[3]]
    for name, disorder in (("late", 0.0), ("allowed", 25.0)):
        progress = horizon.run(stream(spark, str(tmp_path / name), mixed, disorder=disorder), "healpix", 6, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), disorder)
        out = spark.read.parquet(str(tmp_path / f"{name}-out"))
        total, late = out.agg(F.sum("count"), F.sum("late")).first()
        dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"])
        assert total + late + dropped == 1599 and (late + dropped == 0) == (name == "allowed")
        assert out.filter("late = 0").groupBy("cell").count().filter("count > 1").isEmpty()
