"""Well-known binary polygons: cell outlines and reading of rings."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon(ring: list[tuple[float, float]]) -> bytes:
    closed = [*ring, ring[0]]
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)


def _clipped(ring: list[tuple[float, float]], at: float, keep_west: bool) -> list[tuple[float, float]]:
    out = []
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        in0, in1 = (x0 <= at, x1 <= at) if keep_west else (x0 >= at, x1 >= at)
        if in0:
            out.append((x0, y0))
        if in0 != in1:
            out.append((at, y0 + (y1 - y0) * (at - x0) / (x1 - x0)))
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _unpoled(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A corner on a pole has no longitude: it becomes two, at those of its neighbours, if it isn't two already."""
    out, polar = [], [abs(y) > 90 - 1e-9 for _, y in ring]
    for k, (x, y) in enumerate(ring):
        if polar[k] and not (polar[k - 1] or polar[(k + 1) % len(ring)]):
            out += [(ring[k - 1][0], y), (ring[(k + 1) % len(ring)][0], y)]
        else:
            out.append((x, y))
    return out


def cell_outline(lons, lats) -> bytes:
    """A counter-clockwise polygon; over the antimeridian a multipolygon, its western part first.

    A ring that goes once around a pole is closed along the antimeridian and the pole.
    """
    ring = list(zip(map(float, lons), map(float, lats), strict=True))
    if any(abs(y) > 90 - 1e-9 for _, y in ring) and max(x for x, _ in ring) - min(x for x, _ in ring) > 1e-9:
        ring = _unpoled(ring)
    steps = [(b - a + 180) % 360 - 180 for (a, _), (b, _) in zip(ring, [*ring[1:], ring[0]], strict=True)]
    if abs(around := sum(steps)) > 180:
        pole = 90.0 if around > 0 else -90.0
        ring = sorted(ring)
        (x0, y0), (x1, y1) = ring[-1], ring[0]
        edge = y0 + (y1 - y0) * (180 - x0) / (x1 + 360 - x0)
        ring = [(-180.0, edge), *ring, (180.0, edge), (180.0, pole), (-180.0, pole)]
        return polygon(ring if _area(ring) >= 0 else ring[::-1])
    if max(x for x, _ in ring) - min(x for x, _ in ring) > 180:
        first = ring[0][0]
        ring = [(x + 360 if x < first - 180 else x - 360 if x > first + 180 else x, y) for x, y in ring]
        if min(x for x, _ in ring) < -180:
            ring = [(x + 360, y) for x, y in ring]
    ring = ring if _area(ring) >= 0 else ring[::-1]
    if max(x for x, _ in ring) <= 180:
        return polygon(ring)
    parts = [_clipped(ring, 180.0, True), [(x - 360, y) for x, y in _clipped(ring, 180.0, False)]]
    parts = [polygon(p) for p in parts if len(p) > 2 and abs(_area(p)) > 0]
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts)


def read_rings(data: bytes) -> list[list[np.ndarray]]:
    """Polygons as lists of rings of (x, y); either byte order, Z, M and EWKB's SRID are passed over. Other types are an error."""

    def geometry(at: int) -> tuple[list[list[np.ndarray]], int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if kind & 0x20000000:
            at += 4
        size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        base = kind & 0x0FFFFFFF
        size += {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000]
        base %= 1000
        count = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if base in (6, 7):
            out = []
            for _ in range(count):
                got, at = geometry(at)
                out += got
            return out, at
        if base != 3:
            raise ValueError(f"not a polygon: WKB type {base}")
        rings = []
        for _ in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            rings.append(np.frombuffer(data, order + "f8", n * size, at + 4).reshape(n, size)[:, :2].astype(float))
            at += 4 + 8 * n * size
        return [rings], at

    return geometry(0)[0]


def contains(rings: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings."""
    inside = np.zeros(len(x), dtype=bool)
    for poly in rings:
        for ring in poly:
            for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                across = (y0 > y) != (y1 > y)
                if across.any():
                    inside ^= across & (x < (x1 - x0) * (y - y0) / (y1 - y0 if y1 != y0 else 1) + x0)
    return inside


def crosses(rings: list[list[np.ndarray]], cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Whether any edge of each outline (a row of corners) meets an edge of the rings."""
    hit = np.zeros(len(cx), dtype=bool)
    nx, ny = np.roll(cx, -1, axis=1), np.roll(cy, -1, axis=1)
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    for poly in rings:
        for ring in poly:
            for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                a, b = side(x0, y0, x1, y1, cx, cy), side(x0, y0, x1, y1, nx, ny)
                c, d = side(cx, cy, nx, ny, x0, y0), side(cx, cy, nx, ny, x1, y1)
                hit |= ((a * b <= 0) & (c * d <= 0) & ((a != 0) | (b != 0))).any(axis=1)
    return hit


def envelope(data: bytes) -> tuple[float, float, float, float] | None:
    """west, south, east, north of all rings, west from -180 to 180; west over east where it goes over the antimeridian, None without a ring."""
    points = [r for poly in read_rings(data) for r in poly if len(r)]
    if not points:
        return None
    points = np.concatenate(points)
    west, east = float(points[:, 0].min()), float(points[:, 0].max())
    south, north = float(points[:, 1].min()), float(points[:, 1].max())
    if east - west >= 360:
        return -180.0, south, 180.0, north
    turn = 360.0 * float(np.floor((west + 180) / 360))
    west, east = west - turn, east - turn
    return west, south, east - 360 if east > 180 else east, north


def holds_point(lon: Column, lat: Column, data: bytes) -> Column:
    """Whether a constant geometry holds points, on whatever turn of the globe its longitudes are; null for missing coordinates."""

    @F.pandas_udf("boolean")
    def held(x: pd.Series, y: pd.Series) -> pd.Series:
        rings, a, b = read_rings(data), x.to_numpy(dtype=np.float64, na_value=np.nan), y.to_numpy(dtype=np.float64, na_value=np.nan)
        found = np.zeros(len(a), dtype=bool)
        for turn in (-360, 0, 360):
            found |= contains(rings, a + turn, b)
        return pd.Series(found).where(np.isfinite(a) & np.isfinite(b), None)

    return held(lon.cast("double"), lat.cast("double"))
