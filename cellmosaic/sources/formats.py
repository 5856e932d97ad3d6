"""Registration of data sources and of SQL functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions import grids
from cellmosaic.operators import polyfill, states
from cellmosaic.sources.geotiff import PixelSource

VERSION = "0.3"


def register(spark: SparkSession) -> None:
    """format("raster_pixels") with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PixelSource)


def _numbers(cell: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Which of a column's values are cells of a grid, and their ids."""
    where, ids = grids.known(cell.cast(pa.int64()))
    good = grids.valid_ids(ids, name) if len(ids) else np.zeros(0, dtype=bool)
    where = where.copy()
    where[where] = good
    return where, ids[good]


def _levels(resolution: pa.Array) -> np.ndarray:
    return resolution.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _register_grid(spark: SparkSession, name: str) -> None:
    @F.arrow_udf("boolean")
    def is_valid(cell: pa.Array) -> pa.Array:
        return pa.array(_numbers(cell, name)[0])

    @F.arrow_udf("int")
    def get_resolution(cell: pa.Array) -> pa.Array:
        where, ids = _numbers(cell, name)
        out = np.full(len(cell), -1, dtype=np.int32)
        out[where] = grids.grid(name).levels(ids)
        return pa.array(out)

    @F.arrow_udf("bigint")
    def cell_to_parent(cell: pa.Array, resolution: pa.Array) -> pa.Array:
        where, ids = _numbers(cell, name)
        level = _levels(resolution)[where]
        ok = (level >= 0) & (level <= grids.grid(name).levels(ids))
        where[where] = ok
        return grids.spread(where, grids.parents(ids[ok], level[ok], name), pa.int64())

    def part(k: int):
        @F.arrow_udf("double")
        def coordinate(cell: pa.Array) -> pa.Array:
            where, ids = _numbers(cell, name)
            return grids.spread(where, grids.grid(name).centers(ids)[k] if len(ids) else [], pa.float64())

        return coordinate

    @F.arrow_udf("binary")
    def to_wkb(cell: pa.Array) -> pa.Array:
        where, ids = _numbers(cell, name)
        return grids.spread(where, grids.shapes(ids, name), pa.binary())

    @F.arrow_udf("bigint")
    def lonlat_to_cell(lon: pa.Array, lat: pa.Array, resolution: pa.Array) -> pa.Array:
        x, y = (v.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for v in (lon, lat))
        level = _levels(resolution)
        good = np.isfinite(x) & (np.abs(y) <= 90) & (level >= 0) & (level <= grids.grid(name).most)
        out = np.zeros(len(x), dtype=np.int64)
        for r in np.unique(level[good]).tolist():
            own = good & (level == r)
            out[own] = grids.grid(name).cells((x[own] + 180) % 360 - 180, y[own], r)
        return pa.array(out, mask=~good)

    @F.arrow_udf("array<bigint>")
    def polygon_to_cells(geometry: pa.Array, resolution: pa.Array, mode: pa.Array) -> pa.Array:
        rows = zip(geometry.to_pylist(), resolution.to_pylist(), mode.to_pylist(), strict=True)
        return pa.array([polyfill.polygon_cells(g, r, m or "contains_centroid", name).tolist() if g and r is not None else None for g, r, m in rows], pa.list_(pa.int64()))

    made = {"is_valid": is_valid, "get_resolution": get_resolution, "cell_to_parent": cell_to_parent, "to_lng": part(0), "to_lat": part(1), "to_wkb": to_wkb, "to_geometry": to_wkb, "lonlat_to_cell": lonlat_to_cell, "polygon_to_cells": polygon_to_cells}
    for function, udf in made.items():
        if name == "healpix" and function in ("is_valid", "get_resolution", "cell_to_parent"):
            continue  # expressions over built-ins
        spark.udf.register(f"{name}_{function}", udf)
    for function, args, kind, body in (("to_string", "c BIGINT", "STRING", "lower(hex(c))"), ("from_string", "t STRING", "BIGINT", "CASE WHEN trim(t) RLIKE '^[0-9a-fA-F]{1,16}$' THEN CAST(conv(trim(t), 16, -10) AS BIGINT) ELSE 0 END")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{function}({args}) RETURNS {kind} RETURN {body}")
        if function == "from_string":
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION string_to_{name}({args}) RETURNS {kind} RETURN {body}")


def register_sql(spark: SparkSession) -> None:
    """SQL functions of H3, S2 and HEALPix cells: for each grid to_string, from_string, is_valid, get_resolution, cell_to_parent, to_lat, to_lng,
    to_wkb (and to_geometry), lonlat_to_cell and polygon_to_cells(wkb, resolution, mode); merge_cell_states and cellmosaic_version().

    Arrow batches do what isn't bits; HEALPix's bits are expressions over built-ins, so they stay in generated code. polygon_to_cells
    makes an array a row: polygons of very many cells are for operators.polyfill, which deals them out.
    """
    states.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cellmosaic_version() RETURNS STRING RETURN '{VERSION}'")
    for name in grids.GRIDS:
        _register_grid(spark, name)
    for name, args, body in (
        ("healpix_to_string", "c BIGINT", "lower(hex(c))"),
        ("healpix_from_string", "t STRING", "CASE WHEN trim(t) RLIKE '^[0-9a-fA-F]{1,16}$' THEN CAST(conv(trim(t), 16, -10) AS BIGINT) ELSE 0 END"),
        ("healpix_is_valid", "c BIGINT", "coalesce(c >= 4 AND length(bin(c)) <= 62, false)"),
        ("healpix_get_resolution", "c BIGINT", "CASE WHEN coalesce(c >= 4 AND length(bin(c)) <= 62, false) THEN CAST((length(bin(c)) - 3) DIV 2 AS INT) ELSE -1 END"),
        ("healpix_cell_to_parent", "c BIGINT, d INT", "CASE WHEN d >= 0 AND c >= 4 AND length(bin(c)) <= 62 AND d <= (length(bin(c)) - 3) DIV 2 THEN shiftright(c, CAST(2 * ((length(bin(c)) - 3) DIV 2 - d) AS INT)) END"),
    ):
        kind = "STRING" if name.endswith("to_string") else "BOOLEAN" if name.endswith("valid") else "INT" if name.endswith("resolution") else "BIGINT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
