"""NTv2 shift grids: reading of nested grids, lookup of the smallest that holds a point, and shifts there and back.

A file has grids with names and parents. Shifts are bilinear between a grid's nodes; where a child lies within its parent, the child
counts. The way back is found by iteration: from a shifted point the shift is taken off that the point before it would have.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.sources.scratch import filesystem

# Fixed values of the format: records of the file's head and of a grid's, and seconds of the units that it may be in.
_OVERVIEW = ("NUM_OREC", "NUM_SREC", "NUM_FILE", "GS_TYPE", "VERSION", "SYSTEM_F", "SYSTEM_T", "MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T")
_GRID = ("SUB_NAME", "PARENT", "CREATED", "UPDATED", "S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC", "GS_COUNT")
_SECONDS = {"SECONDS": 1.0, "MINUTES": 60.0, "DEGREES": 3600.0}
_RECORD = 16
#: Steps of the way back, and degrees that the last may still move by.
STEPS, CLOSE = 20, 1e-12


@dataclass
class ShiftGrid:
    """One grid: bounds and steps in degrees, longitudes positive east, and shifts (north, east) in degrees by row from the south and column from the west."""

    name: str
    parent: str
    south: float
    north: float
    west: float
    east: float
    lat_step: float
    lon_step: float
    shifts: np.ndarray
    depth: int = 0

    def holds(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return (lon >= self.west) & (lon <= self.east) & (lat >= self.south) & (lat <= self.north)

    def at(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Shifts at points that it holds."""
        rows, columns = self.shifts.shape[:2]
        x, y = (lon - self.west) / self.lon_step, (lat - self.south) / self.lat_step
        c, r = (np.clip(np.floor(v).astype(np.int64), 0, n - 2) for v, n in ((x, columns), (y, rows)))
        tx, ty = (x - c)[:, None], (y - r)[:, None]
        s = self.shifts
        return (s[r, c] * (1 - tx) + s[r, c + 1] * tx) * (1 - ty) + (s[r + 1, c] * (1 - tx) + s[r + 1, c + 1] * tx) * ty


def _invalid(what: str):
    raise ValueError(f"invalid NTv2 file: {what}")


def parse(data: bytes) -> list[ShiftGrid]:
    """Grids of a file, deepest first."""
    if len(data) < _RECORD * len(_OVERVIEW):
        _invalid("too short")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data, 8)[0] == len(_OVERVIEW)), None) or _invalid("no head")

    def head(at: int, names: tuple[str, ...]) -> dict[str, bytes]:
        if len(data) < at + _RECORD * len(names):
            _invalid("cut off")
        out = {}
        for k, name in enumerate(names):
            record = data[at + k * _RECORD : at + (k + 1) * _RECORD]
            if record[:8].rstrip(b" \0") != name.encode():
                _invalid(f"{record[:8]!r} in place of {name}")
            out[name] = record[8:]
        return out

    text = lambda b: b.decode("ascii", "replace").strip(" \0")
    number = lambda b: struct.unpack(order + "d", b)[0]
    whole = lambda b: struct.unpack_from(order + "i", b)[0]
    top = head(0, _OVERVIEW)
    unit = _SECONDS.get(text(top["GS_TYPE"])) or _invalid(f"unit {text(top['GS_TYPE'])!r}")
    at, grids = _RECORD * len(_OVERVIEW), {}
    for _ in range(whole(top["NUM_FILE"])):
        own = head(at, _GRID)
        at += _RECORD * len(_GRID)
        # longitudes of the file are positive west
        south, north, east, west, dy, dx = (number(own[k]) * unit / 3600 for k in ("S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC"))
        if not (np.isfinite([south, north, east, west, dy, dx]).all() and dy > 0 and dx > 0 and north > south and west > east):
            _invalid("bounds or steps")
        rows, columns = round((north - south) / dy) + 1, round((west - east) / dx) + 1
        if abs((north - south) / dy - rows + 1) > 1e-6 or abs((west - east) / dx - columns + 1) > 1e-6 or rows < 2 or columns < 2 or rows * columns != whole(own["GS_COUNT"]):
            _invalid("a grid whose nodes don't fill its bounds")
        if len(data) < at + _RECORD * rows * columns:
            _invalid("cut off")
        nodes = np.frombuffer(data, order + "f4", rows * columns * 4, at).reshape(rows, columns, 4)[:, ::-1, :2].astype(np.float64)
        at += _RECORD * rows * columns
        if not np.isfinite(nodes).all():
            _invalid("shifts that are no numbers")
        name = text(own["SUB_NAME"])
        if name in grids:
            _invalid(f"two grids {name!r}")
        grids[name] = ShiftGrid(name, text(own["PARENT"]), south, north, -west, -east, dy, dx, nodes * np.array([1.0, -1.0]) * unit / 3600)
    for g in grids.values():
        up, g.depth = g, 0
        while up.parent in grids and g.depth <= len(grids):
            up, g.depth = grids[up.parent], g.depth + 1
        if g.depth > len(grids) or (up.parent not in grids and up.parent.upper() != "NONE"):
            _invalid(f"parent {up.parent!r}")
    return sorted(grids.values(), key=lambda g: (-g.depth, (g.north - g.south) * (g.east - g.west)))


def shifts(grids: list[ShiftGrid], lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Shifts (north, east) in degrees at points; NaN where no grid is."""
    out = np.full((len(lon), 2), np.nan)
    for g in grids:
        own = np.isnan(out[:, 0]) & g.holds(lon, lat)
        if own.any():
            out[own] = g.at(lon[own], lat[own])
    return out


def forward(grids: list[ShiftGrid], lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = shifts(grids, lon, lat)
    return lon + s[:, 1], lat + s[:, 0]


def back(grids: list[ShiftGrid], lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points whose shifted places are given; NaN where the iteration leaves the grids or doesn't settle."""
    x, y = lon.copy(), lat.copy()
    apart = np.full(len(lon), np.inf)
    for _ in range(STEPS):
        s = shifts(grids, x, y)
        nx, ny = lon - s[:, 1], lat - s[:, 0]
        apart = np.maximum(np.abs(nx - x), np.abs(ny - y))
        x, y = nx, ny
        if not (apart > CLOSE).any():
            break
    settled = apart <= 1e-9
    return np.where(settled, x, np.nan), np.where(settled, y, np.nan)


@lru_cache(maxsize=8)
def load(path: str) -> list[ShiftGrid]:
    """The grids of a file, read once by a worker."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        return parse(f.read())


def with_shift(rows: DataFrame, path: str, lon: str = "lon", lat: str = "lat", inverse: bool = False) -> DataFrame:
    """lon and lat shifted by the grids of a file (in a folder that tasks can read); null where no grid holds the point."""

    @F.pandas_udf("lon double, lat double")
    def shifted(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = (v.to_numpy(dtype=np.float64, na_value=np.nan) for v in (x, y))
        out = (back if inverse else forward)(load(path), a, b)
        return pd.DataFrame({k: pd.Series(v).where(np.isfinite(v), None) for k, v in zip(("lon", "lat"), out, strict=True)}, dtype="float64")

    at = rows.withColumn("_shifted", shifted(F.col(lon).cast("double"), F.col(lat).cast("double")))
    number = lambda c: F.when(~F.isnan(F.col(f"_shifted.{c}")), F.col(f"_shifted.{c}"))
    return at.withColumns({lon: number("lon"), lat: number("lat")}).drop("_shifted")


def failed(lat: Column) -> Column:
    """How many points no grid held, for an aggregation or an observation."""
    return F.count_if(lat.isNull())


def write(grids: list[ShiftGrid], source: str = "A", target: str = "B", big: bool = False) -> bytes:
    """A file of grids in seconds."""
    order = ">" if big else "<"
    text = lambda s: s.encode().ljust(8)[:8]
    whole = lambda n: struct.pack(order + "ii", n, 0)
    number = lambda x: struct.pack(order + "d", x)
    values = [whole(11), whole(11), whole(len(grids)), text("SECONDS"), text("1"), text(source), text(target), *[number(6378137.0)] * 4]
    out = [text(k) + v for k, v in zip(_OVERVIEW, values, strict=True)]
    for g in grids:
        rows, columns = g.shifts.shape[:2]
        own = [text(g.name), text(g.parent), text(""), text(""), *(number(v * 3600) for v in (g.south, g.north, -g.east, -g.west, g.lat_step, g.lon_step)), whole(rows * columns)]
        out += [text(k) + v for k, v in zip(_GRID, own, strict=True)]
        nodes = np.zeros((rows, columns, 4), dtype=order + "f4")
        nodes[:, :, :2] = (g.shifts * np.array([1.0, -1.0]) * 3600)[:, ::-1]
        out.append(nodes.tobytes())
    return b"".join([*out, b"END     " + bytes(8)])
