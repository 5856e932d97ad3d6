"""Other ways from pixels to cells: interpolation at cell centres and exact areas of overlap with rectangular cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import grids, healpix
from cellmosaic.operators.pixels import over_pole


def _cubic(t: Column) -> list[Column]:
    """Catmull-Rom weights of the taps at -1, 0, 1 and 2."""
    return [((2 - t) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((4 - 3 * t) * t + 1) * t / 2, (t - 1) * t * t / 2]


def _lanczos(t: Column) -> list[Column]:
    """Windowed sinc of radius 3 at the taps -2 to 3, not yet normalised."""

    def kernel(x: Column) -> Column:
        px = x * math.pi
        return F.when(F.abs(x) < 1e-9, F.lit(1.0)).when(F.abs(x) >= 3, F.lit(0.0)).otherwise(3 * F.sin(px) * F.sin(px / 3) / F.when(F.abs(x) >= 1e-9, px * px))

    return [kernel(t - k) for k in range(-2, 4)]


#: Columns of a run of pixels.
_RUN = 16


def on_pixels(parts: DataFrame, pixels: DataFrame) -> DataFrame:
    """Areas (col, row) with their pixels, by a join that is always shuffled.

    Spark's estimate of what a row of cells becomes leaves out how many rows it is exploded into, so that it would broadcast them.
    """
    return parts.hint("merge").join(pixels, ["col", "row"])


_REACH = {"nearest": (0, 0), "bilinear": (0, 1), "bicubic": (-1, 2), "lanczos": (-2, 3)}


def interpolated(centres: DataFrame, pixels: DataFrame, width: int, height: int, origin: tuple[float, float], size: tuple[float, float], kind: str, key: str = "cell") -> DataFrame:
    """value at each centre (key, lon, lat) from pixels (col, row, value); rows of null value are NoData.

    Taps beyond the raster repeat its edge. NoData taps are left out and the rest renormalised if their weights sum to over
    1e-12 in size. Centres off the raster give no row. Taps of a row meet runs of pixels by an equi-join on (row, run), so that a
    centre is exploded into little more rows than it has rows of taps.
    """
    if kind not in _REACH:
        raise ValueError(f"unknown interpolation {kind!r}")
    low, high = _REACH[kind]
    px, py = (F.col("lon") - origin[0]) / size[0], (F.lit(origin[1]) - F.col("lat")) / size[1]
    inside = centres.withColumns({"px": px, "py": py}).filter(F.col("px").between(0, width) & F.col("py").between(0, height))
    half = 0.0 if kind == "nearest" else 0.5
    at = inside.select(key, (F.col("px") - half).alias("x"), (F.col("py") - half).alias("y")).withColumns({"c0": F.floor("x"), "r0": F.floor("y")})
    make = {"nearest": lambda t: [F.lit(1.0)], "bilinear": lambda t: [1 - t, t], "bicubic": _cubic, "lanczos": _lanczos}[kind]
    clamp = lambda v, top: F.greatest(F.least(v, F.lit(top - 1)), F.lit(0)).cast("long")
    steps = range(low, high + 1)
    run = lambda dc: F.floor(clamp(F.col("c0") + dc, width) / _RUN)
    rows = at.select(key, "x", "c0", F.posexplode(F.array(*make(F.col("y") - F.col("r0")))).alias("dr", "b"), "r0")
    taps = rows.select(key, "x", "c0", "b", clamp(F.col("r0") + F.col("dr") + low, height).alias("row"), F.explode(F.sequence(run(low), run(high))).alias("run"))
    place = F.pmod("col", F.lit(_RUN))
    some = lambda k: F.when(place == k, F.col("value"))
    runs = pixels.filter(F.col("value").isNotNull()).groupBy("row", F.floor(F.col("col") / _RUN).alias("run"))
    runs = runs.agg(F.array(*[F.count(some(k)) for k in range(_RUN)]).alias("n"), F.array(*[F.sum(some(k)) for k in range(_RUN)]).alias("s"))
    met = taps.hint("merge").join(runs, ["row", "run"]).withColumns({f"c{k}": clamp(F.col("c0") + dc, width) for k, dc in enumerate(steps)} | {f"a{k}": a for k, a in enumerate(make(F.col("x") - F.col("c0")))})
    here = lambda k, v: F.when(F.floor(F.col(f"c{k}") / _RUN) == F.col("run"), F.col(f"a{k}") * F.get(v, F.pmod(f"c{k}", F.lit(_RUN)).cast("int")))
    along = lambda v: sum((F.coalesce(here(k, v), F.lit(0.0)) for k in range(len(steps))), F.lit(0.0))
    sums = met.groupBy(key).agg(F.sum(F.col("b") * along("n")).alias("w"), F.sum(F.col("b") * along("s")).alias("wv"))
    return sums.filter(F.abs(F.col("w")) > 1e-12).select(key, (F.col("wv") / F.col("w")).alias("value"))


def rectangle_overlaps(cells: DataFrame, width: int, height: int, origin: tuple[float, float], size: tuple[float, float], key: str = "cell") -> DataFrame:
    """(key, col, row, area) of the pixels that each cell's box (west, south, east, north) touches; area as a share of the pixel."""
    x0, x1 = (F.col("west") - origin[0]) / size[0], (F.col("east") - origin[0]) / size[0]
    y0, y1 = (F.lit(origin[1]) - F.col("north")) / size[1], (F.lit(origin[1]) - F.col("south")) / size[1]
    box = cells.select(key, F.greatest(x0, F.lit(0.0)).alias("x0"), F.least(x1, F.lit(float(width))).alias("x1"), F.greatest(y0, F.lit(0.0)).alias("y0"), F.least(y1, F.lit(float(height))).alias("y1")).filter("x0 < x1 and y0 < y1")
    span = lambda a, b: F.sequence(F.floor(a), F.ceil(b) - 1)
    rows = box.withColumn("row", F.explode(span(F.col("y0"), F.col("y1")))).withColumn("col", F.explode(span(F.col("x0"), F.col("x1"))))
    part = lambda a, b, k: F.least(b, k + 1.0) - F.greatest(a, k.cast("double"))
    area = part(F.col("x0"), F.col("x1"), F.col("col")) * part(F.col("y0"), F.col("y1"), F.col("row"))
    return rows.select(key, "col", "row", area.alias("area")).filter("area > 1e-12")


def _under(lo: np.ndarray, hi: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean of the lesser of y and a height that goes evenly from lo to hi."""
    part = np.clip((y - lo) / np.where(hi > lo, hi - lo, 1.0), 0.0, 1.0)
    crossing = part * (lo + y) / 2 + (1 - part) * y
    return np.where(y >= hi, (lo + hi) / 2, np.where(y <= lo, y, crossing))


def pixel_areas(x: np.ndarray, y: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Area of a polygon (x, y in pixels, its last corner joined to the first) in each pixel of the given consecutive columns and rows.

    By Green's theorem the area of a column below a line is an integral along the outline of its height, cut off at the line; a
    pixel's area is a difference of two such. Places are taken from the first pixel and column by column, since differences of
    large areas leave some to pixels that the polygon doesn't touch.
    """
    x, y = x - columns[0], y - rows[0]
    left, below = np.arange(len(columns), dtype=float), np.arange(len(rows) + 1, dtype=float)
    total = np.zeros((len(rows), len(columns)))
    for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
        if x0 == x1:
            continue
        sign = 1.0 if x1 > x0 else -1.0
        (a, ya), (b, yb) = ((x0, y0), (x1, y1)) if x1 > x0 else ((x1, y1), (x0, y0))
        since, until = np.clip(left, a, b), np.clip(left + 1, a, b)
        y_since, y_until = (ya + (yb - ya) * (v - a) / (b - a) for v in (since, until))
        lo, hi = np.minimum(y_since, y_until), np.maximum(y_since, y_until)
        total += sign * (until - since) * np.diff(_under(lo[None, :], hi[None, :], below[:, None]), axis=0)
    return np.abs(total)


def _blocks(first: np.ndarray, last: np.ndarray, step: int) -> Iterator[tuple[int, int, list[int]]]:
    """Blocks of up to so many rows, and which of the spans of rows (first to last) they are of; spans that share rows go together."""
    spans = []
    for a, b, k in sorted(zip(first.tolist(), last.tolist(), range(len(first)), strict=True)):
        if a >= b:
            continue
        if spans and a < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b), [*spans[-1][2], k])
        else:
            spans.append((a, b, [k]))
    for a, b, those in spans:
        for start in range(a, b, step):
            yield start, min(start + step, b), those


#: Cells that may be wider than this take whole pixels by their centres.
COARSE_KM = 500.0


def cell_overlaps(cells: DataFrame, depth: int, width: int, height: int, origin: tuple[float, float], size: tuple[float, float], grid: str = "healpix", over_poles: bool = False) -> DataFrame:
    """(cell, col, row, area) of the pixels that each cell's outline touches; area as a share of the pixel, over 1e-12.

    Outlines are straight between a cell's corners in degrees, so neighbours share their edges and areas add up to whole pixels.
    Cells across the antimeridian are taken on the raster's side. At depths whose cells may be over 500 km wide a pixel belongs
    whole to the cell of its centre. over_poles: a raster goes on over a pole at latitudes of the same sine, where outlines are mirrored.
    """
    own = grids.grid(grid)
    if 2 * own.reach(depth) * 111.2 > COARSE_KM:
        pixels = cells.sparkSession.range(width * height).select((F.col("id") % width).alias("col"), F.floor(F.col("id") / width).alias("row"))
        at = pixels.withColumns({"lon": (F.col("col") + 0.5) * size[0] + origin[0], "lat": F.lit(origin[1]) - (F.col("row") + 0.5) * size[1]})
        if over_poles:
            at = at.withColumn("lat", over_pole(F.col("lat")))
        at = healpix.with_cell(at, depth) if grid == "healpix" else at.withColumn("cell", own.lonlat_to_cell(F.col("lon"), F.col("lat"), depth))
        return at.join(cells.select("cell"), "cell").select("cell", "col", "row", F.lit(1.0).alias("area"))
    middle = origin[0] + width * size[0] / 2
    # from pole to pole and back
    legs = range(math.floor((origin[1] - height * size[1] + 90) / 180), math.floor((origin[1] + 90) / 180) + 1) if over_poles else range(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lon, lat = grids.grid(grid).planar(ids)
            lon = lon + 360 * np.round((middle - lon.mean(axis=1, keepdims=True)) / 360)
            x, y = (lon - origin[0]) / size[0], np.array([(origin[1] - (180 * leg + (-lat if leg % 2 else lat))) / size[1] for leg in legs])
            c0, c1 = np.maximum(np.floor(x.min(axis=1)), 0).astype(int), np.minimum(np.ceil(x.max(axis=1)), width).astype(int)
            r0, r1 = np.maximum(np.floor(y.min(axis=2)), 0).astype(int), np.minimum(np.ceil(y.max(axis=2)), height).astype(int)
            for k in np.flatnonzero((c0 < c1) & (r0 < r1).any(axis=0)):
                columns = np.arange(c0[k], c1[k])
                step = max(1, 200_000 // len(columns))
                for first, last, those in _blocks(r0[:, k], r1[:, k], step):
                    rows = np.arange(first, last)
                    area = sum(pixel_areas(x[k], y[leg, k], columns, rows) for leg in those)
                    at = np.nonzero(area > 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), ids[k])), pa.array(columns[at[1]]), pa.array(rows[at[0]]), pa.array(area[at])], ["cell", "col", "row", "area"])

    return cells.select("cell").mapInArrow(run, "cell long, col long, row long, area double")


def overlay_weights(overlaps: DataFrame, weighted: bool = True, mass_preserve: bool = False, key: str = "cell") -> DataFrame:
    """Adds weight: the area, 1 if unweighted, or the cell's share of all area of the pixel that cells cover."""
    if not weighted:
        return overlaps.withColumn("weight", F.lit(1.0))
    if mass_preserve:
        return overlaps.withColumn("weight", F.col("area") / F.sum("area").over(Window.partitionBy("col", "row")))
    return overlaps.withColumn("weight", F.col("area"))


def coverage(weighed: DataFrame, pixels: DataFrame, key: str = "cell") -> DataFrame:
    """(key, coverage): the share of a cell's weight that lies on valid pixels."""
    joined = on_pixels(weighed, pixels.select("col", "row", "value"))
    return joined.groupBy(key).agg((F.sum(F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")).alias("coverage"))
