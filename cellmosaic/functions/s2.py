"""S2 cells as Spark columns: cube faces, quadratic projection, Hilbert order. Ids keep all 64 bits in a signed long."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 30
#: Hilbert curve, fixed values: place of quadrant 2*i+j in the curve, and change of orientation, by orientation.
IJ_TO_POS = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
POS_TO_ORIENTATION = (1, 0, 0, 3)


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _then(rows: Column, step) -> Column:
    """An array of one struct with the fields that step gives of it: each is worked out once, however often later ones name it."""
    return F.transform(rows, lambda r: F.struct(*[c.alias(name) for name, c in step(r).items()]))


def face_uv(lon: Column, lat: Column) -> Column:
    """Array of one struct of the cube face and u and v, the point's place on it, each from -1 to 1."""
    phi, theta = F.radians(lat), F.radians(lon)
    at = F.array(F.struct((F.cos(phi) * F.cos(theta)).alias("x"), (F.cos(phi) * F.sin(theta)).alias("y"), F.sin(phi).alias("z")))

    def led(r: Column) -> dict[str, Column]:
        ax, ay, az = F.abs(r["x"]), F.abs(r["y"]), F.abs(r["z"])
        return {"x": r["x"], "y": r["y"], "z": r["z"], "axis": F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)}

    def faced(r: Column) -> dict[str, Column]:
        lead = F.when(r["axis"] == 0, r["x"]).when(r["axis"] == 1, r["y"]).otherwise(r["z"])
        return {"x": r["x"], "y": r["y"], "z": r["z"], "face": F.when(lead < 0, r["axis"] + 3).otherwise(r["axis"])}

    def placed(r: Column) -> dict[str, Column]:
        x, y, z, face = r["x"], r["y"], r["z"], r["face"]
        u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
        v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
        return {"face": face, "u": u, "v": v}

    return _then(_then(_then(at, led), faced), placed)


def _st(u: Column) -> Column:
    return F.when(u >= 0, F.sqrt(1 + 3 * F.greatest(u, F.lit(0.0))) * 0.5).otherwise(1 - F.sqrt(1 - 3 * F.least(u, F.lit(0.0))) * 0.5)


def lonlat_to_cell(lon: Column, lat: Column, level: int) -> Column:
    """Id of the cell at this level that holds the point; null outside the globe."""
    if not 0 <= level <= MAX_LEVEL:
        return F.lit(None).cast("long")
    side = 1 << 30
    ij = lambda w: F.least(F.greatest(F.floor(_st(w) * side), _long(0)), _long(side - 1))
    table = F.array(*[F.lit(p) for row in IJ_TO_POS for p in row])
    turns = F.array(*[F.lit(t) for t in POS_TO_ORIENTATION])

    def down(at: Column, k: Column) -> Column:
        i, j = at["i"], at["j"]
        quadrant = F.shiftright(i, 29).bitwiseAND(_long(1)) * 2 + F.shiftright(j, 29).bitwiseAND(_long(1))
        place = F.element_at(table, (at["o"] * 4 + quadrant + 1).cast("int"))
        turned = at["o"].bitwiseXOR(F.element_at(turns, place + 1))
        mask = _long(side - 1)
        return F.struct(at["face"].alias("face"), F.shiftleft(i, 1).bitwiseAND(mask).alias("i"), F.shiftleft(j, 1).bitwiseAND(mask).alias("j"), turned.alias("o"), (at["p"] * 4 + place).alias("p"))

    start = _then(face_uv(lon, lat), lambda r: {"face": r["face"].cast("int"), "i": ij(r["u"]), "j": ij(r["v"])})
    first = _then(start, lambda r: {"face": r["face"], "i": r["i"], "j": r["j"], "o": r["face"].bitwiseAND(F.lit(1)), "p": _long(0)})
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(level)) if level else F.array().cast("array<int>"), first[0], down)
    low = _signed(1 << (60 - 2 * level))
    ok = lat.between(-90, 90) & ~F.isnan(lon) & (F.abs(lon) < F.lit(float("inf")))
    out = F.transform(F.array(walked), lambda w: F.shiftleft(w["face"].cast("long"), 61).bitwiseOR(F.shiftleft(w["p"], 61 - 2 * level)).bitwiseOR(_long(low)))
    return F.when(ok, out[0])


def lowest_bit(cell: Column) -> Column:
    return cell.bitwiseAND(F.bitwise_not(cell) + 1)


def level(cell: Column) -> Column:
    """Level of an id, -1 if it is none."""
    zeros = F.length(F.bin(lowest_bit(cell))) - 1
    return F.when(is_valid(cell), (F.lit(30) - F.shiftright(zeros, 1)).cast("int")).otherwise(F.lit(-1))


def is_valid(cell: Column) -> Column:
    even = lowest_bit(cell).bitwiseAND(_long(0x1555555555555555)) != 0
    return F.coalesce((F.shiftrightunsigned(cell, 61) < 6) & even, F.lit(False))


def cell_to_parent(cell: Column, parent: int) -> Column:
    """Ancestor at a level that isn't finer; null otherwise."""
    low = 1 << (60 - 2 * parent)
    return F.when(is_valid(cell) & (level(cell) >= parent), cell.bitwiseAND(_long(_signed((1 << 64) - low))).bitwiseOR(_long(_signed(low))))


def mean_area_m2(at: int) -> float:
    return 5.100656217240886e14 / (6 * 4**at)


# --- over arrays -----------------------------------------------------------------------------------------------------


def levels(ids: np.ndarray) -> np.ndarray:
    """Levels of valid ids."""
    u = ids.astype(np.int64).view(np.uint64)
    low = u & (~u + np.uint64(1))
    return 30 - (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 1)


def face_ij(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Face, column and row of valid cells among those of their level, and the level: the curve is followed back."""
    u = ids.astype(np.int64).view(np.uint64)
    face, level = (u >> np.uint64(61)).astype(np.int64), levels(ids)
    back = np.argsort(np.array(IJ_TO_POS), axis=1)
    turns, turned = np.array(POS_TO_ORIENTATION), face & 1
    i, j = np.zeros_like(face), np.zeros_like(face)
    for k in range(int(level.max(initial=0))):
        more = level > k
        place = (u >> np.uint64(59 - 2 * k) & np.uint64(3)).astype(np.int64)
        quadrant = back[turned, place]
        i, j = np.where(more, 2 * i + (quadrant >> 1), i), np.where(more, 2 * j + (quadrant & 1), j)
        turned = np.where(more, turned ^ turns[place], turned)
    return face, i, j, level


def _on_sphere(face: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees of places (0 to 1) on cube faces."""
    u, v = (np.where(w >= 0.5, (4 * w * w - 1) / 3, (1 - 4 * (1 - w) * (1 - w)) / 3) for w in (s, t))
    one = np.ones_like(u)
    x = np.choose(face, [one, -u, -u, -one, v, v])
    y = np.choose(face, [u, one, -v, -v, -one, u])
    z = np.choose(face, [v, v, one, -u, -u, -one])
    return np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))


def centers(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes in degrees of valid cells' centres."""
    face, i, j, level = face_ij(ids)
    side = 2.0**level
    return _on_sphere(face, (i + 0.5) / side, (j + 0.5) / side)


def corners(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the four corners of valid cells against the clock, a row each."""
    face, i, j, level = face_ij(ids)
    side, di, dj = 2.0 ** level[:, None], np.array([0, 1, 1, 0]), np.array([0, 0, 1, 1])
    return _on_sphere(np.broadcast_to(face[:, None], (len(face), 4)), (i[:, None] + di) / side, (j[:, None] + dj) / side)


def children(ids: np.ndarray) -> np.ndarray:
    """The four cells of the next level of each cell, a row each."""
    u = ids.astype(np.int64).view(np.uint64)
    low = (u & (~u + np.uint64(1)))[:, None]
    quarter = low >> np.uint64(2)
    return (u[:, None] - low + quarter * np.array([1, 3, 5, 7], dtype=np.uint64)).view(np.int64)


def faces() -> np.ndarray:
    """The six cells of level 0."""
    return (np.arange(6, dtype=np.uint64) << np.uint64(61) | np.uint64(1 << 60)).view(np.int64)


def cells(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """The same as lonlat_to_cell(), over arrays of points on the globe."""
    phi, theta = np.radians(lat), np.radians(lon)
    x, y, z = np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)
    ax, ay, az = np.abs(x), np.abs(y), np.abs(z)
    axis = np.where((ax >= ay) & (ax >= az), 0, np.where(ay >= az, 1, 2))
    face = np.where(np.choose(axis, [x, y, z]) < 0, axis + 3, axis)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    side = 1 << 30
    i, j = (np.clip(np.floor(np.where(w >= 0, np.sqrt(1 + 3 * np.maximum(w, 0)) * 0.5, 1 - np.sqrt(1 - 3 * np.minimum(w, 0)) * 0.5) * side).astype(np.int64), 0, side - 1) for w in (u, v))
    places, turns, turned, place = np.array(IJ_TO_POS), np.array(POS_TO_ORIENTATION), face & 1, np.zeros(len(face), dtype=np.uint64)
    for k in range(level):
        own = places[turned, (i >> 29 - k & 1) * 2 + (j >> 29 - k & 1)]
        place, turned = place << np.uint64(2) | own.astype(np.uint64), turned ^ turns[own]
    return (face.astype(np.uint64) << np.uint64(61) | place << np.uint64(61 - 2 * level) | np.uint64(1 << 60 - 2 * level)).view(np.int64)
