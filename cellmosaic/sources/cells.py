"""format("cells"): statistics of cells straight from raster files, with filters that reach the files.

A partition is a band of chunk rows. What it makes of a cell that lies wholly within the band is final; of a cell that goes over the band's edge
it is a part, told by its `partial_state`. Resolutions and kinds of rows that filters exclude aren't made; a filter on `cell` tells which
chunks can hold pixels of those cells, and the others aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from cellmosaic.functions import bounds, grids
from cellmosaic.operators import continuous, states
from cellmosaic.plans.options import parse_resolutions
from cellmosaic.sources import geotiff

SCHEMA = "resolution int, cell long, count double, sum double, mean double, stddev double, min double, max double, partial_state binary"
_STATISTICS = ("count", "sum", "mean", "stddev", "min", "max")
_OPTIONS = {"path", "grid", "resolutions", "band", "nodata", "scale_offset", "bbox", "source_crs", "target_chunks"}


@dataclass
class Band(InputPartition):
    """Runs of chunks of one file between two latitudes; cells that lie strictly between them are whole."""

    tile: int
    runs: list
    south: float
    north: float
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        super().__init__((self.tile, self.runs[0].first if self.runs else -1))


def _blocks(low: int, high: int) -> Iterator[tuple[int, int]]:
    """(k, number): the fewest blocks of 4^k consecutive numbers, each at a multiple of that, that make up a range."""
    while low <= high:
        k = 0
        while low % 4 ** (k + 1) == 0 and low + 4 ** (k + 1) - 1 <= high:
            k += 1
        yield k, low >> 2 * k
        low += 4**k


def cells_of_range(grid: str, resolution: int, low: int, high: int) -> np.ndarray:
    """Ancestors that hold just the cells of a resolution whose ids, as signed numbers, lie in a range. Grids that nest only."""
    if grid == "healpix":
        first = 4 << 2 * resolution
        low, high = max(low, first), min(high, 4 * first - 1)
        return np.array([(4 << 2 * (resolution - k)) + p for k, p in _capped(low - first, high - first, resolution)], dtype=np.int64)
    out, bit = [], 1 << 60 - 2 * resolution
    for a, b in ((max(low, 0), high), (low + (1 << 64), min(high, -1) + (1 << 64)) if low < 0 else (0, -1)):
        # ids of a level are odd multiples of their lowest bit: number n along the curve is (2 n + 1) of them
        first, last = max(0, -((bit - a) // (2 * bit))), min((6 << 2 * resolution) - 1, (b - bit) // (2 * bit))
        for k, p in _capped(first, last, resolution):
            out.append((2 * p + 1) << 60 - 2 * (resolution - k))
    return np.array(out, dtype=np.uint64).view(np.int64)


def _capped(low: int, high: int, most: int) -> Iterator[tuple[int, int]]:
    """Blocks of at most 4^most."""
    for k, p in _blocks(low, high):
        extra = max(0, k - most)
        yield from ((k - extra, (p << 2 * extra) + j) for j in range(4**extra))


def windows(grid: str, ids: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Boxes in degrees (west over -180, east may go on over 180) around all points of cells."""
    if not len(ids):
        return []
    x, y = grids.grid(grid).planar(ids)
    # sides bulge beyond their ends, most at level 0 of S2, by a seventh of the cell
    wide, high = (x.max(axis=1) - x.min(axis=1)) * 0.2 + 1e-9, (y.max(axis=1) - y.min(axis=1)) * 0.2 + 1e-9
    return list(zip((x.min(axis=1) - wide).tolist(), np.maximum(y.min(axis=1) - high, -90).tolist(), (x.max(axis=1) + wide).tolist(), np.minimum(y.max(axis=1) + high, 90).tolist(), strict=True))


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        if unknown := sorted(k for k in options if k.lower() not in _OPTIONS):
            raise ValueError(f"unknown option of cells: {', '.join(unknown)}")
        self.grid = options.get("grid", "h3")
        own = grids.grid(self.grid)
        self.resolutions = parse_resolutions(options.get("resolutions", "8"), own.name)
        self.globe = tuple(float(v) for v in options["bbox"].split(",")) if "bbox" in options else None
        self.options = {k: v for k, v in options.items() if k in ("path", "band", "nodata", "scale_offset", "source_crs")}
        self.target = int(options.get("target_chunks", "16"))
        self.ids: np.ndarray | None = None
        self.low, self.high = -(1 << 63), (1 << 63) - 1
        self.rows = {"final", "partial"}
        self.least: float | None = None

    def pushFilters(self, filters):
        state = ("partial_state",)
        for f in filters:
            if f.attribute == ("resolution",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                value = getattr(f, "value", None)
                test = {EqualTo: lambda r, v=value: r == v, In: lambda r, v=value: r in v, GreaterThan: lambda r, v=value: r > v, GreaterThanOrEqual: lambda r, v=value: r >= v, LessThan: lambda r, v=value: r < v, LessThanOrEqual: lambda r, v=value: r <= v, IsNotNull: lambda r: True}
                self.resolutions = [r for r in self.resolutions if test[type(f)](r)]
            elif f.attribute == state and isinstance(f, (IsNull, IsNotNull)):
                self.rows &= {"final" if isinstance(f, IsNull) else "partial"}
            elif f.attribute == ("cell",):
                if isinstance(f, (EqualTo, In)):
                    wanted = np.array([f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None], dtype=np.int64)
                    self.ids = wanted if self.ids is None else np.intersect1d(self.ids, wanted)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif f.attribute == ("count",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least or 0.0, float(f.value))
            # Spark tests rows again: of a plan that scans twice it tells scans apart by the filters that are left on them
            yield f

    def _wanted(self) -> list[tuple[float, float, float, float]] | None:
        """Boxes of the cells that filters leave; None if they don't say."""
        if self.ids is not None:
            # ids of other grids and resolutions aren't made by this scan
            own, ids = grids.grid(self.grid), self.ids[(self.ids >= self.low) & (self.ids <= self.high)]
            known = {"h3": lambda c: c >> 59 == 1, "s2": lambda c: c != 0, "healpix": lambda c: c >= 4}[self.grid](ids)
            ids = ids[known]
            ids = ids[np.isin(own.levels(ids), self.resolutions)] if len(ids) else ids
            return windows(self.grid, ids)
        if self.grid == "h3" or (self.low == -(1 << 63) and self.high == (1 << 63) - 1):
            return None
        return [box for r in self.resolutions for box in windows(self.grid, cells_of_range(self.grid, r, self.low, self.high))]

    def partitions(self):
        boxes = self._wanted()
        if not self.resolutions or not self.rows or boxes == []:
            return [Band(-1, [], 0.0, 0.0)]
        pixels = geotiff.PixelReader(self.options)
        paths, out = geotiff.resolve(self.options["path"]), []
        for tile, path in enumerate(paths):
            info = pixels._opened(path)
            code = int(self.options["source_crs"]) if "source_crs" in self.options else info.epsg
            if code is None:
                raise ValueError(f"{path} has no CRS: give source_crs")
            across = -(-info.width // info.box(0)[2]) if info.chunks else 1
            rows, step = -(-info.chunks // across), max(1, self.target // across)
            for first in range(0, rows, step):
                until = min(first + step, rows)
                chunks = self._near(pixels, info, code, range(first * across, min(until * across, info.chunks)), boxes)
                if not chunks:
                    continue
                cuts = [0, *(k for k in range(1, len(chunks)) if chunks[k] != chunks[k - 1] + 1), len(chunks)]
                runs = [geotiff.ChunkRun(tile, info.only(chunks[a:b], pixels._wanted(info)), chunks[a], chunks[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
                row0, row1 = info.box(first * across)[1], min(info.height, info.box((until - 1) * across)[1] + info.box((until - 1) * across)[3])
                whole = code in (4326, 4269) and len(paths) == 1
                north, south = (np.inf if first == 0 else info.origin[1] - row0 * info.pixel[1]), (-np.inf if until == rows else info.origin[1] - row1 * info.pixel[1])
                out.append(Band(tile, runs, south if whole else 0.0, north if whole else 0.0, {"code": code}))
        return out or [Band(-1, [], 0.0, 0.0)]

    def _near(self, pixels, info, code: int, chunks: range, boxes) -> list[int]:
        kept = np.array(pixels._kept(info, chunks), dtype=np.int64)
        if not len(kept) or (boxes is None and self.globe is None):
            return kept.tolist()
        col, row, w, h = np.array([info.box(k) for k in kept.tolist()], dtype=np.float64).T
        x0, y1 = info.origin[0] + col * info.pixel[0], info.origin[1] - row * info.pixel[1]
        at = x0, y1 - h * info.pixel[1], x0 + w * info.pixel[0], y1
        near = np.ones(len(kept), dtype=bool) if self.globe is None else bounds.meets(code, at, self.globe)
        if boxes is not None:
            near &= np.logical_or.reduce([bounds.meets(code, at, (w_, s_, e_, n_)) for w_, s_, e_, n_ in boxes])
        return kept[near].tolist()

    def read(self, part: Band) -> Iterator[pa.RecordBatch]:
        if part.tile < 0:
            return
        pixels, own = geotiff.PixelReader(self.options), grids.grid(self.grid)
        gathered: dict[int, list[np.ndarray]] = {r: [] for r in self.resolutions}
        for run in part.runs:
            for batch in pixels.read(run):
                value = batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
                lon, lat = bounds.points(part.extra["code"], batch.column("x").to_numpy(), batch.column("y").to_numpy())
                good = np.isfinite(value) & np.isfinite(lat)
                if self.globe is not None:
                    west, south, east, north = self.globe
                    good &= (lat >= south) & (lat <= north) & ((lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east))
                for r in self.resolutions:
                    gathered[r].append(_reduced(own.cells(lon[good], lat[good], r), value[good]))
        for r, found in gathered.items():
            cell, n, s, low, high, m2 = _merged(found)
            if not len(cell):
                continue
            y = own.planar(cell)[1]
            slack = (y.max(axis=1) - y.min(axis=1)) * 0.2  # as in windows()
            final = (y.max(axis=1) + slack < part.north) & (y.min(axis=1) - slack > part.south)
            kept = (final & ("final" in self.rows)) | (~final & ("partial" in self.rows))
            if self.least is not None:
                kept &= ~final | (n >= self.least)
            cell, n, s, low, high, m2, final = (v[kept] for v in (cell, n, s, low, high, m2, final))
            deviation = np.sqrt(np.maximum(m2, 0) / np.maximum(n - 1, 1))
            head = states._head("continuous")
            rows = np.stack([n, s, n, low, high, m2], axis=1).astype("<f8")
            packed = pa.array([None if f else head + x.tobytes() for f, x in zip(final.tolist(), rows, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), r, np.int32)), pa.array(cell), *(pa.array(v) for v in (n, s, s / n, deviation, low, high)), packed], ["resolution", "cell", *_STATISTICS, "partial_state"])


def _reduced(cell: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """cell, count, sum, least, greatest and squared deviations of the samples of each cell."""
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    if not len(first):
        return (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(5)))
    n, s = np.diff(np.r_[first, len(cell)]).astype(np.float64), np.add.reduceat(value, first)
    apart = value - np.repeat(s / n, n.astype(np.int64))
    return cell[first], n, s, np.minimum.reduceat(value, first), np.maximum.reduceat(value, first), np.add.reduceat(apart * apart, first)


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    cell, n, s, low, high, m2 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(5)))
    order = np.argsort(cell, kind="stable")
    cell, n, s, low, high, m2 = (v[order] for v in (cell, n, s, low, high, m2))
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    if not len(first):
        return cell, n, s, low, high, m2
    count, total = np.add.reduceat(n, first), np.add.reduceat(s, first)
    apart = s / n - np.repeat(total / count, np.diff(np.r_[first, len(cell)]))
    return cell[first], count, total, np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(m2 + n * apart * apart, first)


class CellSource(DataSource):
    """Options: path, grid, resolutions, band, nodata, scale_offset, bbox (in degrees), source_crs, target_chunks."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """format("cells") with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CellSource)


def finished(rows: DataFrame) -> DataFrame:
    """Final cells of rows of the source: parts are merged, whole cells are as they are, and files are read once."""
    parts = rows.select("resolution", "cell", "count", "sum", F.col("count").alias("sum_w2"), "min", "max", (F.col("stddev") * F.col("stddev") * (F.col("count") - 1)).alias("m2"))
    return continuous.finished(continuous.merge_states(parts, ["resolution", "cell"])).select("resolution", "cell", *_STATISTICS)
