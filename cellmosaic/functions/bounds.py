"""Certified longitudes and latitudes of rectangles in projected coordinates, to leave out data without reading it.

A rectangle's image lies within its bounds, whatever the projection does inside. Where a coordinate is monotone, its values at the ends
are bounds: conics, polar and cylindrical projections have a latitude that follows one distance, whose least and greatest value over a
rectangle are known, and an angle that is extreme at corners. Others are taken in interval arithmetic over parts of the rectangle.
What isn't certified has the whole globe as bounds, and rows are tested one by one.
"""

from __future__ import annotations

import math

import numpy as np

from cellmosaic.functions import crs

GLOBE = (-180.0, -90.0, 180.0, 90.0)
#: Degrees that bounds are widened by: far more than rounding and the series' last terms come to.
SLACK = 1e-6
#: Degrees that a datum shift may move a point by: shifts and turns of the known ones are under 1.2 km together.
SHIFTED = 0.02
#: Parts of a side that rectangles are cut into for interval arithmetic.
PARTS = 4

Interval = tuple[np.ndarray, np.ndarray]


# --- intervals: pairs of arrays, least and greatest -------------------------------------------------------------------


def _hull(*values: np.ndarray) -> Interval:
    return np.minimum.reduce(values), np.maximum.reduce(values)


def _plus(a: Interval, b: Interval) -> Interval:
    return a[0] + b[0], a[1] + b[1]


def _times(a: Interval, b: Interval) -> Interval:
    return _hull(a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1])


def _scaled(a: Interval, k: float) -> Interval:
    return _hull(a[0] * k, a[1] * k)


def _square(a: Interval) -> Interval:
    low, high = _hull(a[0] * a[0], a[1] * a[1])
    return np.where((a[0] <= 0) & (a[1] >= 0), 0.0, low), high


def _sine(a: Interval) -> Interval:
    """Extreme at the ends, or 1 and -1 where a crest or trough lies between them."""
    low, high = _hull(np.sin(a[0]), np.sin(a[1]))
    turn = 2 * math.pi
    crest = np.floor((a[1] - math.pi / 2) / turn) >= np.ceil((a[0] - math.pi / 2) / turn)
    trough = np.floor((a[1] + math.pi / 2) / turn) >= np.ceil((a[0] + math.pi / 2) / turn)
    return np.where(trough, -1.0, low), np.where(crest, 1.0, high)


def _cosine(a: Interval) -> Interval:
    return _sine((a[0] + math.pi / 2, a[1] + math.pi / 2))


def _even(f, a: Interval) -> Interval:
    """An even function that grows with the distance from 0."""
    low, high = _hull(f(a[0]), f(a[1]))
    return np.where((a[0] <= 0) & (a[1] >= 0), f(np.zeros_like(low)), low), high


def _angle(y: Interval, x: Interval) -> tuple[Interval, np.ndarray]:
    """Angles of a box seen from the origin, extreme at its corners; and where that is no bound, since it holds the origin or meets the cut behind it."""
    corners = [np.arctan2(b, a) for a in x for b in y]
    behind = (x[0] <= 0) & (y[0] <= 0) & (y[1] >= 0)
    return _hull(*corners), behind


def _distance(x: Interval, y: Interval) -> Interval:
    a, b = _square(x), _square(y)
    return np.sqrt(a[0] + b[0]), np.sqrt(a[1] + b[1])


# --- latitudes --------------------------------------------------------------------------------------------------------


def _conformal_back(psi: np.ndarray, e: float) -> np.ndarray:
    """Geodetic latitude of an isometric one; it grows with it."""
    phi = np.arctan(np.sinh(psi))
    for _ in range(12):
        phi = np.arctan(np.sinh(psi + e * np.arctanh(e * np.sin(phi))))
    return phi


def _authalic_back(beta: np.ndarray, f: float) -> np.ndarray:
    _, _, series = crs._authalic(f)
    return beta + sum(c * np.sin(2 * k * beta) for k, c in enumerate(series, 1))


class _Parts:
    """Rectangles in parts, and bounds of the parts' images put together again."""

    def __init__(self, west, south, east, north):
        w, s, e, n = (np.asarray(v, dtype=np.float64)[:, None, None] for v in (west, south, east, north))
        k = np.arange(PARTS)
        self.x = (np.broadcast_to(w + (e - w) * k[:, None] / PARTS, (len(w), PARTS, PARTS)), np.broadcast_to(w + (e - w) * (k[:, None] + 1) / PARTS, (len(w), PARTS, PARTS)))
        self.y = (np.broadcast_to(s + (n - s) * k / PARTS, (len(w), PARTS, PARTS)), np.broadcast_to(s + (n - s) * (k + 1) / PARTS, (len(w), PARTS, PARTS)))

    @staticmethod
    def whole(lam: Interval, phi: Interval, lost: np.ndarray) -> tuple[Interval, Interval, np.ndarray]:
        joined = lambda a: (a[0].min(axis=(1, 2)), a[1].max(axis=(1, 2)))
        return joined(lam), joined(phi), lost.any(axis=(1, 2))


def _oblique(x: Interval, y: Interval, p: dict[str, float], a: float, f: float) -> tuple[Interval, Interval, np.ndarray]:
    """Lambert's azimuthal equal-area projection: sin(c) / r falls with r, cos(c) too, and the rest are products and sums of these."""
    q, qp, _ = crs._authalic(f)
    e2, origin = 2 * f - f * f, math.radians(p["lat"])
    beta0, rq = math.asin(q(origin) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(origin) / math.sqrt(1 - e2 * math.sin(origin) ** 2) / (rq * math.cos(beta0))
    east, north = _scaled(x, 1 / d), _scaled(y, d)
    r = _distance(east, north)
    lost = r[1] >= 1.99 * rq
    r = (np.minimum(r[0], 1.99 * rq), np.minimum(r[1], 1.99 * rq))
    half = lambda v: np.sqrt(1 - (v / (2 * rq)) ** 2) / rq  # noqa: E731  sin(c) / r, with c = 2 asin(r / 2 rq)
    cos = lambda v: 1 - v * v / (2 * rq * rq)
    k, c = (half(r[1]), half(r[0])), (cos(r[1]), cos(r[0]))
    s = _plus(_scaled(c, math.sin(beta0)), _scaled(_times(north, k), math.cos(beta0)))
    beta = tuple(np.arcsin(np.clip(v, -1, 1)) for v in s)
    lam, behind = _angle(_times(east, k), _plus(_scaled(c, math.cos(beta0)), _scaled(_times(north, k), -math.sin(beta0))))
    return lam, tuple(_authalic_back(b, f) for b in beta), lost | behind


def _transverse(x: Interval, y: Interval, p: dict[str, float], a: float, f: float) -> tuple[Interval, Interval, np.ndarray]:
    """Krueger's series term by term."""
    third, e = f / (2 - f), math.sqrt(2 * f - f * f)
    big = a * (1 + third**2 / 4 + third**4 / 64) / (1 + third)
    beta = (third / 2 - 2 * third**2 / 3 + 37 * third**3 / 96 - third**4 / 360, third**2 / 48 + third**3 / 15 - 437 * third**4 / 1440, 17 * third**3 / 480 - 37 * third**4 / 840, 4397 * third**4 / 161280)
    xi, eta = _plus(_scaled(y, 1 / (p["k"] * big)), (a * crs._meridian_northing(p["lat"], f) / big,) * 2), _scaled(x, 1 / (p["k"] * big))
    lost = (np.maximum(np.abs(eta[0]), np.abs(eta[1])) > 1) | (np.maximum(np.abs(xi[0]), np.abs(xi[1])) > 1.5)  # beyond, the series isn't trusted
    xi, eta = tuple(np.clip(v, -1.5, 1.5) for v in xi), tuple(np.clip(v, -1, 1) for v in eta)
    one, two = xi, eta
    for k, b in enumerate(beta, 1):
        up, aside = _scaled(xi, 2 * k), _scaled(eta, 2 * k)
        one = _plus(one, _scaled(_times(_sine(up), _even(np.cosh, aside)), -b))
        two = _plus(two, _scaled(_times(_cosine(up), (np.sinh(aside[0]), np.sinh(aside[1]))), -b))
    flat = _even(np.cosh, two)
    sin_chi = _times(_sine(one), (1 / flat[1], 1 / flat[0]))
    phi = tuple(_conformal_back(np.arctanh(np.clip(s, -1 + 1e-12, 1 - 1e-12)), e) for s in sin_chi)
    lam, behind = _angle((np.sinh(two[0]), np.sinh(two[1])), _cosine(one))
    return lam, phi, lost | behind


def _conic(x: Interval, y: Interval, method: str, p: dict[str, float], a: float, f: float) -> tuple[Interval, Interval, np.ndarray]:
    """Conics: latitude follows the distance from the apex, longitude the angle there."""
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    m = lambda phi: math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    one, two, origin = (math.radians(p[k]) for k in ("one", "two", "lat"))
    if method == "lcc":
        t = lambda phi: math.exp(-(math.asinh(math.tan(phi)) - e * math.atanh(e * math.sin(phi))))
        n = math.sin(one) if one == two else (math.log(m(one)) - math.log(m(two))) / (math.log(t(one)) - math.log(t(two)))
        c = m(one) / (n * t(one) ** n)
        rho0, latitude = a * c * t(origin) ** n, lambda rho: _conformal_back(-np.log(np.maximum(rho / (a * abs(c)), 1e-300)) / n, e)
    else:
        q, qp, _ = crs._authalic(f)
        n = (m(one) ** 2 - m(two) ** 2) / (q(two) - q(one))
        c = m(one) ** 2 + n * q(one)
        rho0, latitude = a * math.sqrt(c - n * q(origin)) / n, lambda rho: _authalic_back(np.arcsin(np.clip((c - rho * rho * (n / a) ** 2) / n / qp, -1, 1)), f)
    sign = 1.0 if n > 0 else -1.0
    down = _scaled((rho0 - y[1], rho0 - y[0]), sign)
    rho = _distance(x, down)
    angle, behind = _angle(_scaled(x, sign), down)
    return _scaled(angle, 1 / n), _hull(latitude(rho[0]), latitude(rho[1])), behind


def _polar(x: Interval, y: Interval, true_lat: float, f: float) -> tuple[Interval, Interval, np.ndarray]:
    a, e = crs.WGS84_A, math.sqrt(2 * f - f * f)
    sign, phi_c = (1.0 if true_lat > 0 else -1.0), math.radians(abs(true_lat))
    s = math.sin(phi_c)
    t_c = math.tan(math.pi / 4 - phi_c / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    m_c = math.cos(phi_c) / math.sqrt(1 - e * e * s * s)
    rho = _distance(x, y)
    latitude = lambda r: sign * _conformal_back(-np.log(np.maximum(r * t_c / (a * m_c), 1e-300)), e)
    ahead = (-y[1], -y[0]) if sign > 0 else y
    angle, behind = _angle(x, ahead)
    return angle, _hull(latitude(rho[0]), latitude(rho[1])), behind


def lonlat_bounds(code: int, west, south, east, north) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """west, south, east, north of certified bounds in WGS84 degrees of rectangles, and whether they are certified.

    West is from -180 to 180 and east at least as much; east over 180 goes on over the antimeridian. A rectangle for which nothing is
    proven, and each of an unknown CRS, has the whole globe.
    """
    w, s, e, n = (np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in (west, south, east, north))
    proven = np.isfinite(w) & np.isfinite(s) & np.isfinite(e) & np.isfinite(n) & (w <= e) & (s <= n)
    x, y = tuple(np.where(proven, v, 0.0) for v in (w, e)), tuple(np.where(proven, v, 0.0) for v in (s, n))
    central, pad, around = 0.0, SLACK, np.zeros(len(w), dtype=bool)
    wgs = 1 / 298.257223563
    if code in (4326, 4269):
        lam, phi = tuple(np.radians(v) for v in x), tuple(np.radians(v) for v in y)
    elif code in (3857, 900913, 3785):
        lam, phi = tuple(v / crs.WGS84_A for v in x), tuple(np.arctan(np.sinh(v / crs.WGS84_A)) for v in y)
    elif code in crs.ALBERS:
        one, two, lat, central = crs.ALBERS[code]
        lam, phi, around = _conic(x, y, "aea", {"one": one, "two": two, "lat": lat}, crs.WGS84_A, crs.GRS80_F)
    elif 32601 <= code <= 32660 or 32701 <= code <= 32760:
        central, parts = code % 100 * 6 - 183.0, _Parts(w - 500000, s - (1e7 if code > 32700 else 0), e - 500000, n - (1e7 if code > 32700 else 0))
        lam, phi, around = _Parts.whole(*_transverse(parts.x, parts.y, {"lat": 0.0, "k": 0.9996}, crs.WGS84_A, wgs))
    elif code in (3413, 3031):
        true_lat, central = (70.0, -45.0) if code == 3413 else (-71.0, 0.0)
        lam, phi, around = _polar(x, y, true_lat, wgs)
    else:
        try:
            method, p, ellipsoid, shift = crs.definition(code)
        except ValueError:
            method = ""
        if method in ("", "sterea"):
            proven[:] = False
            lam = phi = (np.zeros(len(w)), np.zeros(len(w)))
        else:
            (a, f), central = crs.ELLIPSOIDS[ellipsoid], p["lon"]
            x, y = tuple(v - p["x"] for v in x), tuple(v - p["y"] for v in y)
            if method == "lcc":
                lam, phi, around = _conic(x, y, "lcc", p, a, f)
            elif method == "cea":
                _, qp, _ = crs._authalic(f)
                true, e2 = math.radians(p["true"]), 2 * f - f * f
                k0 = math.cos(true) / math.sqrt(1 - e2 * math.sin(true) ** 2)
                lam, phi = _scaled(x, 1 / (a * k0)), tuple(_authalic_back(np.arcsin(np.clip(v * 2 * k0 / (a * qp), -1, 1)), f) for v in y)
            else:
                parts = _Parts(x[0], y[0], x[1], y[1])
                lam, phi, around = _Parts.whole(*(_oblique if method == "laea" else _transverse)(parts.x, parts.y, p, a, f))
            pad += SHIFTED if shift else 0.0
    # around a pole or behind the origin only longitudes are unbounded, except where a series isn't trusted
    proven &= ~around if code not in (3413, 3031) else True
    low, high = np.degrees(phi[0]) - pad, np.degrees(phi[1]) + pad
    wide = pad / np.maximum(np.cos(np.radians(np.minimum(np.maximum(np.abs(low), np.abs(high)), 89.9))), 1e-3)
    left, right = np.degrees(lam[0]) + central - wide, np.degrees(lam[1]) + central + wide
    all_round = around | (right - left >= 360)
    turn = np.floor((left + 180) / 360) * 360
    left, right = np.where(all_round, -180.0, left - turn), np.where(all_round, 180.0, right - turn)
    low, high = np.maximum(low, -90.0), np.minimum(high, 90.0)
    return tuple(np.where(proven, v, g) for v, g in zip((left, low, right, high), GLOBE, strict=True)) + (proven,)


def points(code: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of points, by the same formulas over rectangles without extent; NaN where there is no point. Shifted datums are refused."""
    wgs = 1 / 298.257223563
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if code in (4326, 4269):
        return np.where(np.abs(y) <= 90, (x + 180) % 360 - 180, np.nan), np.where(np.abs(y) <= 90, y, np.nan)
    central, lost = 0.0, np.zeros(x.shape, dtype=bool)
    if code in (3857, 900913, 3785):
        lam, phi = x / crs.WGS84_A, np.arctan(np.sinh(y / crs.WGS84_A))
    elif code in (3413, 3031):
        true_lat, central = (70.0, -45.0) if code == 3413 else (-71.0, 0.0)
        (lam, _), (phi, _), _ = _polar((x, x), (y, y), true_lat, wgs)
    else:
        if code in crs.ALBERS:
            one, two, lat, lon = crs.ALBERS[code]
            method, p, ellipsoid, shift = "aea", {"one": one, "two": two, "lat": lat, "lon": lon, "x": 0.0, "y": 0.0}, "GRS80", None
        elif 32601 <= code <= 32660 or 32701 <= code <= 32760:
            method, p, ellipsoid, shift = "tm", {"lat": 0.0, "lon": code % 100 * 6 - 183.0, "k": 0.9996, "x": 5e5, "y": 1e7 if code > 32700 else 0.0}, "WGS84", None
        else:
            method, p, ellipsoid, shift = crs.definition(code)
        if shift or method not in ("aea", "lcc", "laea", "tm"):
            raise ValueError(f"no points of EPSG:{code} over arrays")
        (a, f), central = crs.ELLIPSOIDS[ellipsoid], p["lon"]
        at = (x - p["x"],) * 2, (y - p["y"],) * 2
        if method in ("aea", "lcc"):
            (lam, _), (phi, _), _ = _conic(*at, method, p, a, f)
        else:
            (lam, _), (phi, _), lost = (_oblique if method == "laea" else _transverse)(*at, p, a, f)
    lon, lat = np.degrees(lam) + central, np.degrees(phi)
    good = np.isfinite(lon) & np.isfinite(lat) & (np.abs(lat) <= 90) & ~lost
    return np.where(good, (lon + 180) % 360 - 180, np.nan), np.where(good, lat, np.nan)


def meets(code: int, rectangles, bbox: tuple[float, float, float, float]) -> np.ndarray:
    """Which rectangles (west, south, east, north in the CRS) may hold points of a box in degrees, whose west over its east crosses the antimeridian."""
    left, low, right, high, _ = lonlat_bounds(code, *rectangles)
    west, south, east, north = bbox
    east = east + 360 if west > east else east
    aside = np.logical_or.reduce([(left + turn <= east) & (right + turn >= west) for turn in (-360, 0, 360)])
    return aside & (low <= north) & (high >= south)
