"""What polygon fill, outlines and scans need to know of a grid, over arrays: centres, outlines, children, reach."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmosaic.functions import h3, h3bits, healpix, s2, wkb


def _around(lat: np.ndarray, lng: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.degrees(lng) + 180) % 360 - 180, np.degrees(lat), count


def _unpoled(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outlines of four vertices; one on a pole, which has no longitude, becomes two at those of its neighbours."""
    lon, lat, count = np.c_[lon, lon[:, 3]], np.c_[lat, lat[:, 3]], np.full(len(lon), 4)
    for row, k in np.argwhere(np.abs(lat[:, :4]) > 90 - 1e-9):
        x, y = lon[row, :4], lat[row, :4]
        lon[row], lat[row] = np.r_[x[:k], x[k - 1], x[(k + 1) % 4], x[k + 1 :]], np.r_[y[:k], y[k], y[k], y[k + 1 :]]
        count[row] = 5
    return lon, lat, count


@dataclass(frozen=True)
class Grid:
    """centers(ids) gives longitudes and latitudes in degrees; outlines(ids) rows of vertices against the clock, filled up with the last, and their numbers.

    reach(at) bounds, in degrees of arc, how far any cell under a cell at a resolution goes from that cell's centre.
    """

    name: str
    most: int
    roots: Callable[[], np.ndarray]
    children: Callable[[np.ndarray], np.ndarray]
    levels: Callable[[np.ndarray], np.ndarray]
    centers: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    outlines: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    reach: Callable[[int], float]
    valid: Callable[[Column], Column]
    lonlat_to_cell: Callable[[Column, Column, int], Column]
    to_parent: Callable[[Column, int, int], Column]
    cells: Callable[[np.ndarray, np.ndarray, int], np.ndarray]

    def planar(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outlines as rings of the plane of longitude and latitude, a row each: longitudes go on over the antimeridian, and a ring around a pole is closed along the antimeridian and the pole."""
        lon, lat, _ = self.outlines(ids)
        steps = (np.roll(lon, -1, axis=1) - lon + 180) % 360 - 180
        x = lon[:, :1] + np.c_[np.zeros(len(ids)), np.cumsum(steps[:, :-1], axis=1)]
        around = steps.sum(axis=1)
        x, y = np.c_[x, np.repeat(x[:, -1:], 4, axis=1)], np.c_[lat, np.repeat(lat[:, -1:], 4, axis=1)]
        for row in np.flatnonzero(np.abs(around) > 180):  # two of a resolution at most
            ring = wkb.read_rings(wkb.cell_outline(lon[row], lat[row]))[0][0][:-1]
            ring = np.r_[ring, np.repeat(ring[-1:], x.shape[1] - len(ring), axis=0)] if len(ring) <= x.shape[1] else ring[: x.shape[1]]
            x[row], y[row] = ring.T
        return x, y


def _healpix_levels(ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(4 << 2 * np.arange(30, dtype=np.int64), ids.astype(np.int64), "right") - 1


def _by_level(run: Callable[[np.ndarray, int], tuple[np.ndarray, ...]]):
    """HEALPix functions take cells of one depth; ids of several are taken depth by depth."""

    def each(ids: np.ndarray) -> tuple[np.ndarray, ...]:
        level = _healpix_levels(ids)
        some = np.unique(level)
        if len(some) == 1:
            return run(ids, int(some[0]))
        parts = [(np.flatnonzero(level == d), run(ids[level == d], int(d))) for d in some]
        if not parts:
            return run(ids, 0)
        out = [np.empty((len(ids), *x.shape[1:])) for x in parts[0][1]]
        for at, got in parts:
            for whole, x in zip(out, got, strict=True):
                whole[at] = x
        return tuple(out)

    return each


def _h3_reach(at: int) -> float:
    """A gnomonic plane only shrinks onto the sphere: steps to children add up to 0.608 of the cell's width, and half the finest's diagonal is left."""
    return min(90.0, math.degrees(h3.UNIT * 7 ** (-at / 2) * 1.2))


GRIDS = {
    "h3": Grid(
        "h3", 15, h3.base_cells, h3.children, lambda ids: ids.astype(np.int64) >> 52 & 15, lambda ids: (lambda p: ((np.degrees(p[1]) + 180) % 360 - 180, np.degrees(p[0])))(h3.centres(ids)),
        lambda ids: _around(*h3.outlines(ids)), _h3_reach, h3bits.is_valid, h3.lonlat_to_cell, lambda c, _, r: h3bits.cell_to_parent(c, r), lambda lon, lat, r: h3.cells(np.radians(lat), np.radians(lon), r),
    ),
    # half the longest diagonal of a cell is 1.22 of its level's unit
    "s2": Grid("s2", 30, s2.faces, lambda ids: s2.children(ids).ravel(), s2.levels, s2.centers, lambda ids: _unpoled(*s2.corners(ids)), lambda at: min(90.0, math.degrees(1.4 / 2**at)), s2.is_valid, s2.lonlat_to_cell, lambda c, _, r: s2.cell_to_parent(c, r), s2.cells),
    "healpix": Grid(
        "healpix", 29, lambda: np.arange(4, 16, dtype=np.int64), lambda ids: (ids[:, None] * 4 + np.arange(4)).ravel(), _healpix_levels, _by_level(healpix.centers), lambda ids: _unpoled(*_by_level(healpix.corners)(ids)),
        healpix.radius_deg, lambda c: (c >= 4) & (F.length(F.bin(c)) <= 62) & (F.length(F.bin(c)) > 2), healpix.lonlat_to_cell, healpix.cell_to_parent, healpix.cells,
    ),
}


def grid(name: str) -> Grid:
    if name not in GRIDS:
        raise ValueError(f"no grid {name!r}; one of {', '.join(GRIDS)}")
    return GRIDS[name]


def valid_ids(ids: np.ndarray, name: str) -> np.ndarray:
    """Which of an array's ids are cells of a grid."""
    u = ids.astype(np.int64)
    if name == "healpix":
        # an id of depth d lies from 4^(d+1) on and under 16 of 4^d
        return np.logical_or.reduce([(u >= 4 << 2 * d) & (u <= (16 << 2 * d) - 1) for d in range(30)])
    if name == "s2":
        v = u.view(np.uint64)
        low = v & (~v + np.uint64(1))
        return (v >> np.uint64(61) < 6) & (low & np.uint64(0x1555555555555555) != 0)
    level, digits = u >> 52 & 15, np.stack([u >> 3 * (14 - k) & 7 for k in range(15)])
    used = np.arange(15)[:, None] < level
    first = np.where(used & (digits > 0), digits, 0)
    lead = np.take_along_axis(first, np.argmax(first > 0, axis=0)[None, :], axis=0)[0]
    return (u >> 59 == 1) & (u >> 56 & 7 == 0) & (u >> 45 & 127 < 122) & np.where(used, digits < 7, digits == 7).all(axis=0) & ~(np.isin(u >> 45 & 127, h3.pentagons()) & (lead == 1))


def parents(ids: np.ndarray, level: np.ndarray, name: str) -> np.ndarray:
    """Ancestors of valid ids at levels that aren't finer than theirs."""
    u = ids.astype(np.int64)
    if name == "healpix":
        return u >> 2 * (_healpix_levels(u) - level)
    if name == "s2":
        low = np.uint64(1) << (np.uint64(60) - np.uint64(2) * level.astype(np.uint64))
        return (u.view(np.uint64) & ~(low - np.uint64(1)) & ~low | low).view(np.int64)
    return u & ~np.int64(15 << 52) | level.astype(np.int64) << 52 | (np.int64(1) << 3 * (15 - level.astype(np.int64))) - 1


def mean_area_m2(name: str, level: int) -> float:
    return {"h3": lambda r: h3bits.MEAN_AREA_M2[r], "s2": s2.mean_area_m2, "healpix": healpix.mean_area_m2}[name](level)


def matched_resolution(name: str, area: float, offset: int = 0) -> int:
    """The resolution whose mean cell is nearest to an area in square metres, by ratio, so many steps finer, within the grid's range."""
    most = grid(name).most
    near = min(range(most + 1), key=lambda r: abs(math.log(mean_area_m2(name, r) / area)))
    return min(max(near + offset, 0), most)


def known(cell: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are not null, and those. Ids go by Arrow: pandas makes whole numbers beside nulls floating, which lose digits."""
    return np.asarray(cell.is_valid()), cell.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def spread(where: np.ndarray, values, kind: pa.DataType) -> pa.Array:
    """Values where they belong, nulls elsewhere."""
    at = np.cumsum(where) - 1
    return pa.array(values, kind).take(pa.array(np.where(where, at, 0), mask=~where))


def center(cell: Column, name: str) -> tuple[Column, Column]:
    """Longitude (-180 to 180) and latitude of valid cells' centres in degrees; null for null and invalid ids."""
    own = grid(name)

    def part(k: int) -> Column:
        @F.arrow_udf("double")
        def degrees(cell: pa.Array) -> pa.Array:
            where, ids = known(cell)
            return spread(where, grid(name).centers(ids)[k] if len(ids) else [], pa.float64())

        return degrees(F.when(own.valid(cell), cell))

    return part(0), part(1)


def shapes(ids: np.ndarray, name: str) -> list[bytes]:
    """Outlines of valid ids as WKB."""
    return [wkb.cell_outline(x[:n], y[:n]) for x, y, n in zip(*grid(name).outlines(ids), strict=True)] if len(ids) else []


def to_wkb(cell: Column, name: str) -> Column:
    """Outlines of valid cells as WKB polygons against the clock, cut at the antimeridian; null for null and invalid ids.

    A cell that holds a pole is closed along the antimeridian and the pole.
    """
    own = grid(name)

    @F.arrow_udf("binary")
    def outline(cell: pa.Array) -> pa.Array:
        where, ids = known(cell)
        return spread(where, shapes(ids, name), pa.binary())

    return outline(F.when(own.valid(cell), cell))


def to_boundary(cell: Column, name: str) -> Column:
    """Vertices of valid cells against the clock, as structs of lat and lng in degrees; null for null and invalid ids."""
    own = grid(name)

    @F.arrow_udf("array<struct<lat double, lng double>>")
    def vertices(cell: pa.Array) -> pa.Array:
        where, ids = known(cell)
        lon, lat, count = grid(name).outlines(ids) if len(ids) else (np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64))
        made = [[{"lat": b, "lng": a} for a, b in zip(x[:n], y[:n], strict=True)] for x, y, n in zip(lon.tolist(), lat.tolist(), count.tolist(), strict=True)]
        return spread(where, made, pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())])))

    return vertices(F.when(own.valid(cell), cell))
