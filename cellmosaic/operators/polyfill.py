"""Polygon to cells by descent of a grid's hierarchy, over rows of polygons.

Tests are in the plane of longitude and latitude, as cells' outlines are given. H3's cells aren't made up of their children, so the
descent goes by how far any descendant lies from a cell's centre, which holds for every grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import grids, wkb

#: Containment modes and their other names: cells whose centre the polygon holds, that it holds whole, that lie in it or cross its
#: boundary, and that share any point with it. The last two differ by cells that hold the whole polygon; of grids that nest, both are the last.
MODES = {"contains_centroid": "centroid", "centroid": "centroid", "contains_boundary": "inside", "intersects_boundary": "crosses", "intersects": "covers", "covers": "covers", "overlapping": "covers"}


#: So many cells of a polygon go together from round to round, are tested at a time, and are remembered of polygons that a task has filled.
_TOGETHER, _HELD, _KNOWN = 16, 20_000, 1_000_000


def _mode(mode: str, grid: str) -> str:
    how = MODES.get(mode.lower().replace("-", "_"))
    if how is None:
        raise ValueError(f"unknown containment {mode!r}")
    return "covers" if how == "crosses" and grid != "h3" else how


def _box(rings: list) -> tuple[float, float, float, float]:
    points = np.concatenate([r for poly in rings for r in poly])
    return points[:, 0].min(), points[:, 1].min(), points[:, 0].max(), points[:, 1].max()


def _near(grid: grids.Grid, box: tuple[float, float, float, float], cells: np.ndarray, at: int) -> np.ndarray:
    """Those cells under which some may meet the box."""
    west, south, east, north = box
    lon, lat = grid.centers(cells)
    reach = grid.reach(at)
    wide = reach / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat) + reach, 89.9))), 0.001)
    return cells[(lat >= south - reach) & (lat <= north + reach) & np.logical_or.reduce([(lon + turn >= west - wide) & (lon + turn <= east + wide) for turn in (-360, 0, 360)])]


def _descended(grid: grids.Grid, rings: list, cells: np.ndarray, at: int, until: int) -> np.ndarray:
    """Cells at a finer resolution under the given ones that may meet the polygon's box."""
    box = _box(rings)
    while True:
        cells = _near(grid, box, cells, at)
        if at == until or not len(cells):
            return cells
        cells, at = grid.children(cells), at + 1


def _holds(x: np.ndarray, y: np.ndarray, px: float, py: float) -> np.ndarray:
    """Whether each ring (a row) holds a point."""
    nx, ny = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    across = (y > py) != (ny > py)
    return (across & (px < x + (py - y) / np.where(ny != y, ny - y, 1) * (nx - x))).sum(axis=1) % 2 == 1


def _held(grid: grids.Grid, rings: list, cells: np.ndarray, how: str) -> np.ndarray:
    """Those cells that the polygon holds or meets in the way asked for. A cell is tested on every turn of the globe that the polygon's longitudes reach."""
    if not len(cells):
        return cells
    west, south, east, north = _box(rings)
    kept = np.zeros(len(cells), dtype=bool)
    if how == "centroid":
        lon, lat = grid.centers(cells)
        for turn in (-360, 0, 360):
            some = (lon + turn >= west) & (lon + turn <= east)
            kept[some] |= wkb.contains(rings, lon[some] + turn, lat[some])
        return cells[kept]
    x, y = grid.planar(cells)
    for turn in (-360, 0, 360):
        some = np.flatnonzero((x.max(axis=1) + turn >= west) & (x.min(axis=1) + turn <= east) & (y.max(axis=1) >= south) & (y.min(axis=1) <= north))
        if not len(some):
            continue
        cx, cy = x[some] + turn, y[some]
        crossed = wkb.crosses(rings, cx, cy)
        inside = wkb.contains(rings, cx.ravel(), cy.ravel()).reshape(cx.shape)
        # a ring that lies in the cell without crossing it: a hole in it, or the whole polygon
        swallowed = [[_holds(cx, cy, *ring[0]) for ring in poly] for poly in rings]
        if how == "inside":
            kept[some] |= inside.all(axis=1) & ~crossed & ~np.logical_or.reduce([s for poly in swallowed for s in poly])
        else:
            kept[some] |= inside.any(axis=1) | crossed
            if how == "covers":
                kept[some] |= np.logical_or.reduce([poly[0] for poly in swallowed])
    return cells[kept]


def polygon_cells(data: bytes, depth: int, mode: str = "contains_centroid", grid: str = "healpix") -> np.ndarray:
    """Sorted ids of one polygon's cells, in one go."""
    own, rings = grids.grid(grid), wkb.read_rings(data)
    return np.sort(_held(own, rings, _descended(own, rings, own.roots(), 0, depth), _mode(mode, grid)))


def polygons_to_cells(polygons: DataFrame, depth: int, mode: str = "contains_centroid", key: str = "key", geometry: str = "wkb", levels: int | None = None, grid: str = "healpix") -> DataFrame:
    """(key, cell) of each polygon's cells; null and empty geometries give none.

    Each round takes the cells that are left some levels down, in tasks of their own, so that one large polygon spreads over
    tasks and none holds more than a few thousand cells for each of _TOGETHER that it began with. A round's cells of a polygon
    stay together by so many, and polygons that a task has just filled are not filled again.
    """
    own, how, at = grids.grid(grid), _mode(mode, grid), 0
    if not 0 <= depth <= own.most:
        raise ValueError(f"resolutions of {grid} are 0 to {own.most}")
    if levels is None:
        levels = 4 if grid == "h3" else 6
    roots = F.array(*[F.lit(c) for c in own.roots().tolist()])
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own, since a small file of polygons is one task and small shuffles are put together
    front = polygons.select(F.col(key).cast("long").alias("key"), F.col(geometry).alias("wkb")).filter(F.length("wkb") > 0).repartition(tasks, "key").withColumn("cells", roots)

    def step(at: int, until: int):
        def under(tree: grids.Grid, data: bytes, cells: np.ndarray) -> np.ndarray:
            rings, found = wkb.read_rings(data), []
            cells = _near(tree, _box(rings), cells, at)
            for first in range(0, len(cells), _TOGETHER):
                some = _descended(tree, rings, cells[first : first + _TOGETHER], at, until)
                found += [_held(tree, rings, some[k : k + _HELD], how) for k in range(0, len(some), _HELD)] if until == depth else [some]
            return np.concatenate(found) if found else cells[:0]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
            tree, known, held = grids.grid(grid), {}, 0
            for batch in batches:
                lists = batch.column(2)
                ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                for k, g, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                    name = (g, ids[a:b].tobytes())
                    if name not in known:
                        if held > _KNOWN:
                            known, held = {}, 0
                        known[name] = under(tree, g, ids[a:b])
                        held += len(known[name]) + len(g) // 8 + b - a + 100
                    yield k, g, known[name]

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, cells, size = [], [], 0
            for k, _, some in each(batches):
                for first in range(0, len(some), _HELD):
                    part = some[first : first + _HELD]
                    keys.append(np.full(len(part), k, dtype=np.int64))
                    cells.append(part)
                    size += len(part)
                    if size >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cells))], ["key", "cell"])
                        keys, cells, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cells))], ["key", "cell"])

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, g, some in each(batches):
                lists = [some[first : first + _TOGETHER] for first in range(0, len(some), _TOGETHER)]
                if lists:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(lists), pa.int64()), pa.array([g] * len(lists), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["key", "wkb", "cells"])

        return last if until == depth else between

    while True:
        until = min(depth, at + levels)
        if until == depth:
            return front.mapInArrow(step(at, until), "key long, cell long")
        front = front.mapInArrow(step(at, until), "key long, wkb binary, cells array<long>").repartition(tasks, "key", "cells")
        at = until
