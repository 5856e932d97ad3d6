"""H3 cells of points.

A point falls on one of the icosahedron's twenty faces, is projected from the sphere's centre to that face's plane and rounded to
the nearest hexagon of the wanted resolution. Each coarser parent is the nearest hexagon of a lattice that is seven times as wide
and turned; a digit tells the child from its parent's centre. The last parent is one of 122 base cells, whose own orientation the
digits are turned to. Numpy over Arrow batches; ids as signed longs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmosaic.functions import h3bits

# Fixed values of the grid: latitude and longitude of the faces' centres and azimuth of their first axis, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055), (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154), (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535), (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# Fixed values of the grid: face and coordinates i, j, k of each base cell's centre; those at 2 0 0 are the pentagons.
BASE_CELLS = (
    (1, 1, 0, 0), (2, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0), (1, 0, 0, 1), (2, 0, 0, 0), (0, 1, 0, 0), (2, 0, 1, 0),
    (1, 0, 1, 0), (1, 0, 1, 1), (3, 1, 0, 0), (3, 1, 1, 0), (11, 2, 0, 0), (4, 1, 0, 0), (0, 0, 0, 0), (6, 0, 1, 0), (0, 0, 0, 1), (2, 0, 1, 1),
    (7, 0, 0, 1), (2, 0, 0, 1), (0, 1, 1, 0), (6, 0, 0, 1), (10, 2, 0, 0), (6, 0, 0, 0), (3, 0, 0, 0), (11, 1, 0, 0), (4, 1, 1, 0), (3, 0, 1, 0),
    (0, 0, 1, 1), (4, 0, 0, 0), (5, 0, 1, 0), (0, 0, 1, 0), (7, 0, 1, 0), (11, 1, 1, 0), (7, 0, 0, 0), (10, 1, 0, 0), (12, 2, 0, 0), (6, 1, 0, 1),
    (7, 1, 0, 1), (4, 0, 0, 1), (3, 0, 0, 1), (3, 0, 1, 1), (4, 0, 1, 0), (6, 1, 0, 0), (11, 0, 0, 0), (8, 0, 0, 1), (5, 0, 0, 1), (14, 2, 0, 0),
    (5, 0, 0, 0), (12, 1, 0, 0), (10, 1, 1, 0), (4, 0, 1, 1), (12, 1, 1, 0), (7, 1, 0, 0), (11, 0, 1, 0), (10, 0, 0, 0), (13, 2, 0, 0), (10, 0, 0, 1),
    (11, 0, 0, 1), (9, 0, 1, 0), (8, 0, 1, 0), (6, 2, 0, 0), (8, 0, 0, 0), (9, 0, 0, 1), (14, 1, 0, 0), (5, 1, 0, 1), (16, 0, 1, 1), (8, 1, 0, 1),
    (5, 1, 0, 0), (12, 0, 0, 0), (7, 2, 0, 0), (12, 0, 1, 0), (10, 0, 1, 0), (9, 0, 0, 0), (13, 1, 0, 0), (16, 0, 0, 1), (15, 0, 1, 1), (15, 0, 1, 0),
    (16, 0, 1, 0), (14, 1, 1, 0), (13, 1, 1, 0), (5, 2, 0, 0), (8, 1, 0, 0), (14, 0, 0, 0), (9, 1, 0, 1), (14, 0, 0, 1), (17, 0, 0, 1), (12, 0, 0, 1),
    (16, 0, 0, 0), (17, 0, 1, 1), (15, 0, 0, 1), (16, 1, 0, 1), (9, 1, 0, 0), (15, 0, 0, 0), (13, 0, 0, 0), (8, 2, 0, 0), (13, 0, 1, 0), (17, 1, 0, 1),
    (19, 0, 1, 0), (14, 0, 1, 0), (19, 0, 1, 1), (17, 0, 1, 0), (13, 0, 0, 1), (17, 0, 0, 0), (16, 1, 0, 0), (9, 2, 0, 0), (15, 1, 0, 1), (15, 1, 0, 0),
    (18, 0, 1, 1), (18, 0, 0, 1), (19, 0, 0, 1), (17, 1, 0, 0), (19, 0, 0, 0), (18, 0, 1, 0), (18, 1, 0, 1), (19, 2, 0, 0), (19, 1, 0, 0), (18, 0, 0, 0),
    (19, 1, 0, 1), (18, 1, 0, 0),
)
#: Edge of a hexagon's cell of resolution 0 in the plane of a face, and the turn between lattices of even and odd resolutions.
UNIT, TURN = 0.38196601125010500003, float(np.arctan(np.sqrt(3) / 5))
MOST_RESOLUTION = 15
#: Digits by the steps along i and j that they stand for; the third axis steps back along both.
_DIGITS = {(0, 0): 0, (-1, -1): 1, (0, 1): 2, (-1, 0): 3, (1, 0): 4, (0, -1): 5, (1, 1): 6}
_DIGIT_OF = np.zeros((3, 3), dtype=np.int64)
for (_a, _b), _digit in _DIGITS.items():
    _DIGIT_OF[_a + 1, _b + 1] = _digit
#: Digits after a turn by 60 degrees against the clock: the axes in that order are 4, 6, 2, 3, 1, 5.
_ROUND = (4, 6, 2, 3, 1, 5)
TURNED = np.zeros((6, 7), dtype=np.int64)
for _k in range(6):
    for _at, _digit in enumerate(_ROUND):
        TURNED[_k, _digit] = _ROUND[(_at + _k) % 6]

_CENTRES = np.array([(np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)) for lat, lng, _ in FACES])
_LAT, _LNG, _AXIS = (np.array(x) for x in zip(*FACES, strict=True))


def _azimuth(lat0, lng0, lat1, lng1):
    return np.arctan2(np.cos(lat1) * np.sin(lng1 - lng0), np.cos(lat0) * np.sin(lat1) - np.sin(lat0) * np.cos(lat1) * np.cos(lng1 - lng0))


def _on_face(lat: np.ndarray, lng: np.ndarray, face: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the plane of a face, in units of resolution 0 with the first axis along x."""
    xyz = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=-1)
    away = np.arccos(np.clip(1 - ((xyz - _CENTRES[face]) ** 2).sum(axis=-1) / 2, -1, 1))
    far, angle = np.tan(away) / UNIT, _AXIS[face] - _azimuth(_LAT[face], _LNG[face], lat, lng)
    return far * np.cos(angle), far * np.sin(angle)


def _on_sphere(x: float, y: float, face: int) -> tuple[float, float]:
    """Latitude and longitude of a place in the plane of a face."""
    away, azimuth, lat0 = np.arctan(np.hypot(x, y) * UNIT), _AXIS[face] - np.arctan2(y, x), _LAT[face]
    lat = np.arcsin(np.clip(np.sin(lat0) * np.cos(away) + np.cos(lat0) * np.sin(away) * np.cos(azimuth), -1, 1))
    return lat, _LNG[face] + np.arctan2(np.sin(azimuth) * np.sin(away) * np.cos(lat0), np.cos(away) - np.sin(lat0) * np.sin(lat))


def _plane(i: float, j: float, k: float) -> tuple[float, float]:
    return i - (j + k) / 2, (j - k) * np.sqrt(0.75)


@cache
def base_cell_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each face and i, j, k of 0 to 2: base cell, turns from the face's digits to the base cell's, and for pentagons which way a first digit of the deleted axis turns.

    All of it follows from geometry: the base cell is the one whose centre is there, and turns are the angle between the face's
    and the home face's first axis, seen at that centre. Around a pentagon five faces meet, of which each next one against the
    clock is one more turn; a face that has the pentagon on its second axis counts from the next slot on and turns back.
    """
    homes = BASE_CELLS
    centres = np.array([_on_sphere(*_plane(*ijk), face) for face, *ijk in homes])
    xyz = np.stack([np.cos(centres[:, 0]) * np.cos(centres[:, 1]), np.cos(centres[:, 0]) * np.sin(centres[:, 1]), np.sin(centres[:, 0])], axis=1)
    cell, turns, back = (np.zeros((20, 3, 3, 3), dtype=np.int64) for _ in range(3))
    for face, i, j, k in np.ndindex(20, 3, 3, 3):
        x, y = _plane(i, j, k)
        lat, lng = _on_sphere(x, y, face)
        found = int(np.argmax(xyz @ [np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)]))
        cell[face, i, j, k] = found
        home = homes[found][0]
        if homes[found][1:] == (2, 0, 0):
            spokes = _azimuth(*centres[found], _LAT, _LNG)
            near = np.argsort(-(_CENTRES @ xyz[found]))[:5]
            if face in near:
                steps = int(round((spokes[home] - spokes[face]) % (2 * np.pi) / (2 * np.pi / 5))) % 5
                slot = {(2, 0, 0): 0, (0, 2, 0): 1, (0, 0, 2): 3}.get((i, j, k), 0)
                turns[face, i, j, k], back[face, i, j, k] = (steps - slot) % 5, slot == 1
        else:
            ahead = _on_sphere(x + 0.1, y, face)
            (x0, x1), (y0, y1) = _on_face(np.array([lat, ahead[0]]), np.array([lng, ahead[1]]), np.array([home, home]))
            turns[face, i, j, k] = int(round(np.arctan2(y1 - y0, x1 - x0) / (np.pi / 3))) % 6
    return cell, turns, back


def cells(lat: np.ndarray, lng: np.ndarray, resolution: int) -> np.ndarray:
    """Ids of points in radians."""
    xyz = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
    face = np.argmax(xyz @ _CENTRES.T, axis=1)
    x, y = _on_face(lat, lng, face)
    turn, scale = (TURN if resolution % 2 else 0.0), np.sqrt(7.0) ** resolution
    x, y = (x * np.cos(turn) + y * np.sin(turn)) * scale, (y * np.cos(turn) - x * np.sin(turn)) * scale
    # nearest hexagon: of three coordinates that add up to zero the one that rounding moved most follows from the others
    q, r = x - y / np.sqrt(3.0), y * 2 / np.sqrt(3.0)
    rounded = np.rint(np.stack([q, r, -q - r]))
    off = np.abs(rounded - np.stack([q, r, -q - r]))
    first = (off[0] > off[1]) & (off[0] > off[2])
    second = ~first & (off[1] > off[2])
    q = np.where(first, -rounded[1] - rounded[2], rounded[0]).astype(np.int64)
    b = np.where(second, -rounded[0] - rounded[2], rounded[1]).astype(np.int64)
    a = q + b
    digits = np.zeros((resolution + 1, len(lat)), dtype=np.int64)
    for level in range(resolution, 0, -1):
        if level % 2:
            up = np.rint((3 * a - b) / 7).astype(np.int64), np.rint((a + 2 * b) / 7).astype(np.int64)
            centre = 2 * up[0] + up[1], 3 * up[1] - up[0]
        else:
            up = np.rint((2 * a + b) / 7).astype(np.int64), np.rint((3 * b - a) / 7).astype(np.int64)
            centre = 3 * up[0] - up[1], up[0] + 2 * up[1]
        digits[level] = _DIGIT_OF[a - centre[0] + 1, b - centre[1] + 1]
        a, b = up
    low = np.minimum(np.minimum(a, b), 0)
    table, turns, back = base_cell_table()
    at = (face, a - low, b - low, -low)
    base, turn = table[at], turns[at]
    own, digits = np.isin(base, pentagons()), digits[1 : resolution + 1]
    if own.any() and resolution:
        some = digits[:, own]
        some = TURNED[np.where(_leading(some) == 1, np.where(back[at][own] == 1, 5, 1), 0), some]
        for step in range(int(turn[own].max())):
            some = np.where(turn[own] > step, _skipping(some), some)
    digits = TURNED[turn, digits]
    if own.any() and resolution:
        digits[:, own] = some
    out = (1 << 59) | (resolution << 52) | (base << 45) | ((1 << 3 * (MOST_RESOLUTION - resolution)) - 1)
    for level in range(resolution):
        out |= digits[level] << (3 * (MOST_RESOLUTION - 1 - level))
    return out


@cache
def _crossings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each face and edge (that opposite corner 0, 1 or 2): the face beyond, and turn and shift of the plane into its own."""
    corner = 2 * np.exp(2j * np.pi * np.arange(3) / 3)
    places = np.array([[_on_sphere(c.real, c.imag, f) for c in corner] for f in range(20)])
    xyz = np.stack([np.cos(places[..., 0]) * np.cos(places[..., 1]), np.cos(places[..., 0]) * np.sin(places[..., 1]), np.sin(places[..., 0])], axis=-1)
    same = np.einsum("fix,gjx->fgij", xyz, xyz) > 1 - 1e-6  # corners of two faces that are one point
    beyond, turn, shift = np.zeros((20, 3), dtype=np.int64), np.zeros((20, 3), dtype=complex), np.zeros((20, 3), dtype=complex)
    for f in range(20):
        for k in range(3):
            p, q = (k + 1) % 3, (k + 2) % 3
            g = next(g for g in range(20) if g != f and same[f, g, p].any() and same[f, g, q].any())
            m, n = int(np.argmax(same[f, g, p])), int(np.argmax(same[f, g, q]))
            beyond[f, k], turn[f, k] = g, (corner[n] - corner[m]) / (corner[q] - corner[p])
            shift[f, k] = corner[m] - turn[f, k] * corner[p]
    return beyond, turn, shift


_INWARD = -np.exp(-2j * np.pi * np.arange(3) / 3)


def _across(z: np.ndarray, face: np.ndarray, edge: np.ndarray, crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places beyond an edge of their face, carried into the plane of the face there."""
    beyond, turn, shift = _crossings()
    return np.where(crossed, turn[face, edge] * z + shift[face, edge], z), np.where(crossed, beyond[face, edge], face)


def _folded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of valid cells the centre in the plane of the face that it is on, that face, the resolution, and whether it is a pentagon.

    Digits lead from the base cell's centre to a place in its home face's plane, which is unfolded: a place beyond an edge is
    carried into the plane of the face there, until it is inside one. Around a pentagon's corner a sixth of the plane is
    missing; what the digits put behind the gap is turned to its other side, and the rest is reached the other way round.
    """
    ids = ids.astype(np.int64)
    level, base = ids >> 52 & 15, ids >> 45 & 127
    home = np.array([(f, i - k, j - k) for f, i, j, k in BASE_CELLS])
    face, a, b = (home[base, k].copy() for k in range(3))
    digits = np.stack([np.where(level > k, ids >> (3 * (MOST_RESOLUTION - 1 - k)) & 7, 0) for k in range(MOST_RESOLUTION)])
    own = np.isin(base, pentagons())
    pentagon = own & ~digits.any(axis=0)
    first = np.where(own, _leading(digits), 0)
    digits = np.where(first == 5, TURNED[5, digits], digits)
    steps = np.zeros((7, 2), dtype=np.int64)
    for step, digit in _DIGITS.items():
        steps[digit] = step
    for k in range(int(level.max(initial=0))):
        down = (2 * a + b, 3 * b - a) if k % 2 == 0 else (3 * a - b, a + 2 * b)
        more = level > k
        a, b = np.where(more, down[0] + steps[digits[k], 0], a), np.where(more, down[1] + steps[digits[k], 1], b)
    z = (a - b / 2 + 1j * b * np.sqrt(0.75)) / np.sqrt(7.0) ** level * np.exp(1j * np.where(level % 2 == 1, TURN, 0.0))
    for turns in range(8):
        out = (z[:, None] * _INWARD).real
        edge, crossed = np.argmax(out, axis=1), out.max(axis=1) > 1 + 1e-9
        if turns == 0:
            edge = np.where(np.isin(first, (2, 4, 6)), 2, edge)
        if not crossed.any():
            break
        z, face = _across(z, face, edge, crossed)
    return z, face, level, pentagon


def centres(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes in radians of valid cells' centres."""
    z, face, _, _ = _folded(ids)
    return _on_sphere(z.real, z.imag, face)


def outlines(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitudes and longitudes in radians of valid cells' vertices against the clock, a row each, and how many there are; rows are filled up with the last.

    A hexagon's vertices lie around its centre in the plane of the centre's face; those beyond an edge are carried over. At odd
    resolutions sides may cross an edge of the icosahedron between their ends, where the outline has a bend: one more vertex.
    Around a pentagon each of five faces has one vertex, and at odd resolutions each edge between them one.
    """
    z, face, level, pentagon = _folded(ids)
    reach, lean = 1 / np.sqrt(3.0) / np.sqrt(7.0) ** level, np.where(level % 2 == 1, TURN, 0.0)
    around = z[:, None] + reach[:, None] * np.exp(1j * (np.pi / 6 + np.pi / 3 * np.arange(6) + lean[:, None]))
    lat, lng = np.full((len(z), 12), np.nan), np.full((len(z), 12), np.nan)
    out = (around[:, :, None] * _INWARD).real
    edge, beyond = np.argmax(out, axis=2), out.max(axis=2) > 1 + 1e-9
    for k in range(6):
        place, on = around[:, k], face
        for _ in range(2):
            over = (place[:, None] * _INWARD).real
            place, on = _across(place, on, np.argmax(over, axis=1), over.max(axis=1) > 1 + 1e-9)
        lat[:, 2 * k], lng[:, 2 * k] = _on_sphere(place.real, place.imag, on)
        n = (k + 1) % 6
        # a side with one end beyond an edge, neither on it, bends there
        e = np.where(beyond[:, k], edge[:, k], edge[:, n])
        here, there = (around[:, k] * _INWARD[e]).real, (around[:, n] * _INWARD[e]).real
        bent = (beyond[:, k] != beyond[:, n]) & (level % 2 == 1) & (np.abs(here - 1) > 1e-9) & (np.abs(there - 1) > 1e-9)
        part = np.where(bent, (1 - here) / np.where(there != here, there - here, 1), 0)
        at = around[:, k] + part * (around[:, n] - around[:, k])
        y, x = _on_sphere(at.real, at.imag, face)
        lat[bent, 2 * k + 1], lng[bent, 2 * k + 1] = y[bent], x[bent]
    for row in np.flatnonzero(pentagon):
        lat[row], lng[row] = _pentagon(z[row], int(face[row]), int(level[row]))
    count = np.isfinite(lat).sum(axis=1)
    order = np.argsort(~np.isfinite(lat), axis=1, kind="stable")
    last = np.minimum(np.arange(12), count[:, None] - 1)
    rows = np.arange(len(z))[:, None]
    return lat[rows, order[rows, last]], lng[rows, order[rows, last]], count


def base_cells() -> np.ndarray:
    """The 122 cells of resolution 0."""
    return (1 << 59) | np.arange(122, dtype=np.int64) << 45 | ((1 << 45) - 1)


def children(ids: np.ndarray) -> np.ndarray:
    """Cells of the next resolution under each cell, one after the other: seven, or six under a pentagon."""
    ids = ids.astype(np.int64)
    shift = 3 * (MOST_RESOLUTION - 1 - (ids >> 52 & 15))
    below = (ids + (1 << 52) & ~(np.int64(7) << shift))[:, None] | np.arange(7) << shift[:, None]
    digits = ids & (1 << 45) - 1
    zeros = digits == (np.int64(1) << shift + 3) - 1  # no digit but 0 so far
    kept = np.ones(below.shape, dtype=bool)
    kept[np.isin(ids >> 45 & 127, pentagons()) & zeros, 1] = False
    return below[kept]


def _pentagon(z: complex, face: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices around a corner of a face: those in each of the five faces that meet there, and where sides cross from face to face."""
    corner = 2 * np.exp(2j * np.pi * np.arange(3) / 3)
    lat0, lng0 = _on_sphere(z.real, z.imag, face)
    reach, odd = 1 / np.sqrt(3.0) / np.sqrt(7.0) ** level, level % 2 == 1
    places = []
    for g in range(20):
        for c in corner:
            lat1, lng1 = _on_sphere(c.real, c.imag, g)
            if np.sin(lat0) * np.sin(lat1) + np.cos(lat0) * np.cos(lat1) * np.cos(lng1 - lng0) < 1 - 1e-9:
                continue
            inward, lean = np.angle(-c), np.pi / 6 - TURN if odd else np.pi / 6
            places.append((g, c + reach * np.exp(1j * (inward - lean))))
            if odd:
                places.append((g, c + reach * np.cos(np.pi / 6) / np.cos(lean) * np.exp(1j * (inward - np.pi / 6))))
    found = [_on_sphere(p.real, p.imag, g) for g, p in places]
    found.sort(key=lambda f: -float(_azimuth(lat0, lng0, *f)))
    out = np.full((2, 12), np.nan)
    out[:, : len(found)] = np.array(found).T
    return out[0], out[1]


@cache
def pentagons() -> np.ndarray:
    return np.flatnonzero([c[1:] == (2, 0, 0) for c in BASE_CELLS])


def _leading(digits: np.ndarray) -> np.ndarray:
    """First digit that is not 0 of each column; 0 if there is none."""
    return np.take_along_axis(digits, np.argmax(digits > 0, axis=0)[None, :], axis=0)[0]


def _skipping(digits: np.ndarray) -> np.ndarray:
    """One turn against the clock, two where the first would lead to the deleted axis."""
    once = TURNED[1, digits]
    return np.where(_leading(once) == 1, TURNED[1, once], once)


def lonlat_to_cell(lon: Column, lat: Column, resolution: int) -> Column:
    """H3 cell of a point in degrees; null off the globe, and for null or not finite coordinates."""
    if not 0 <= resolution <= MOST_RESOLUTION:
        raise ValueError(f"H3 resolutions are 0 to {MOST_RESOLUTION}")

    @F.pandas_udf("long")
    def cell(lon: pd.Series, lat: pd.Series) -> pd.Series:
        x, y = lon.to_numpy(dtype=np.float64, na_value=np.nan), lat.to_numpy(dtype=np.float64, na_value=np.nan)
        good = np.isfinite(x) & (np.abs(y) <= 90)
        out = pd.array(np.zeros(len(x), dtype=np.int64), dtype="Int64")
        out[good] = cells(np.radians(y[good]), np.radians(x[good]), resolution)
        out[~good] = pd.NA
        return pd.Series(out)

    return cell(lon.cast("double"), lat.cast("double"))


def _centre(part: int):
    @F.arrow_udf("double")
    def degrees(cell: pa.Array) -> pa.Array:
        # by Arrow: pandas makes whole numbers beside nulls floating, which lose an id's last digits
        known = np.asarray(cell.is_valid())
        out = np.full(len(cell), np.nan)
        if known.any():
            got = np.degrees(centres(cell.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))[part])
            out[known] = (got + 180) % 360 - 180 if part else got
        return pa.array(out, mask=~known)

    return degrees


def cell_to_lat(cell: Column) -> Column:
    """Latitude of a valid cell's centre in degrees; null for null and invalid ids."""
    return _centre(0)(F.when(h3bits.is_valid(cell), cell))


def cell_to_lng(cell: Column) -> Column:
    """Longitude of a valid cell's centre in degrees, -180 to 180."""
    return _centre(1)(F.when(h3bits.is_valid(cell), cell))
