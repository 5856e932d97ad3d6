"""Inverse map projections as Spark columns: metres to WGS84 degrees."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cellmosaic.functions import crs_text

WGS84_A = 6378137.0
GRS80_F = 1 / 298.257222101
#: Standard parallels, origin latitude and central meridian, fixed values.
ALBERS = {5070: (29.5, 45.5, 23.0, -96.0), 3338: (55.0, 65.0, 50.0, -154.0)}


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_A), F.degrees(F.atan(F.exp(y / WGS84_A)) * 2 - math.pi / 2)


def albers_constants(code: int) -> dict[str, float]:
    """Snyder's constants of an equal-area conic on GRS80, and the series from authalic to geodetic latitude."""
    one, two, origin, meridian = (math.radians(v) for v in ALBERS[code])
    e2 = 2 * GRS80_F - GRS80_F**2
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    m = lambda phi: math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    n = (m(one) ** 2 - m(two) ** 2) / (q(two) - q(one))
    c = m(one) ** 2 + n * q(one)
    return {
        "n": n, "c": c, "rho0": WGS84_A * math.sqrt(c - n * q(origin)) / n, "qp": q(math.pi / 2), "meridian": meridian,
        "p1": e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, "p2": 23 * e2**2 / 360 + 251 * e2**3 / 3780, "p3": 761 * e2**3 / 45360,
    }


def albers_inverse(x: Column, y: Column, code: int = 5070) -> tuple[Column, Column]:
    k = albers_constants(code)
    down = F.lit(k["rho0"]) - y
    rho2 = x * x + down * down
    theta = F.atan2(x, down) if k["n"] > 0 else F.atan2(-x, -down)
    s = (F.lit(k["c"]) - rho2 * (k["n"] ** 2 / WGS84_A**2)) / k["n"] / k["qp"]
    beta = F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))
    lat = beta + F.sin(beta * 2) * k["p1"] + F.sin(beta * 4) * k["p2"] + F.sin(beta * 6) * k["p3"]
    return F.degrees(theta / k["n"] + k["meridian"]), F.degrees(lat)


def transverse_mercator_inverse(x: Column, y: Column, meridian: float, scale: float = 0.9996, false_east: float = 500000.0, false_north: float = 0.0, flattening: float = 1 / 298.257223563) -> tuple[Column, Column]:
    """Krueger's series to the fourth order, from a central meridian in degrees."""
    n = flattening / (2 - flattening)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    xi, eta = (y - false_north) / (scale * a), (x - false_east) / (scale * a)
    xi1, eta1 = xi, eta
    for k, b in enumerate(beta, 1):
        xi1 = xi1 - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
        eta1 = eta1 - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    e = math.sqrt(2 * flattening - flattening**2)
    # conformal to geodetic latitude by four fixed-point steps
    psi = F.log((1 + F.sin(chi)) / (1 - F.sin(chi))) / 2
    phi = chi
    for _ in range(4):
        t = F.sin(phi) * e
        phi = F.atan(F.sinh(psi + F.log((1 + t) / (1 - t)) * (e / 2)))
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + meridian, F.degrees(phi)


def utm_inverse(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    return transverse_mercator_inverse(x, y, zone * 6 - 183, false_north=1e7 if south else 0.0)


def polar_stereographic_inverse(x: Column, y: Column, true_lat: float, meridian: float, flattening: float = 1 / 298.257223563) -> tuple[Column, Column]:
    """EPSG 3413 is (70, -45), 3031 is (-71, 0)."""
    e = math.sqrt(2 * flattening - flattening**2)
    sign = 1 if true_lat > 0 else -1
    phi_c = math.radians(abs(true_lat))
    s = math.sin(phi_c)
    t_c = math.tan(math.pi / 4 - phi_c / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    m_c = math.cos(phi_c) / math.sqrt(1 - e * e * s * s)
    t = F.sqrt(x * x + y * y) * (t_c / (WGS84_A * m_c))
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(5):
        w = F.sin(phi) * e
        phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - w) / (1 + w), F.lit(e / 2))) * 2
    lon = F.degrees(F.atan2(x, -y if sign > 0 else y)) + meridian
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(phi) * sign


def inverse(code: int, x: Column, y: Column) -> tuple[Column, Column]:
    """WGS84 longitude and latitude of projected coordinates, by EPSG code; an unknown code is an error."""
    if code in (4326, 4269):
        return x, y
    if code in (3857, 900913, 3785):
        return web_mercator_inverse(x, y)
    if code in ALBERS:
        return albers_inverse(x, y, code)
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return utm_inverse(x, y, code % 100, code > 32700)
    if code in (3413, 3031):
        return polar_stereographic_inverse(x, y, *((70.0, -45.0) if code == 3413 else (-71.0, 0.0)))
    raise ValueError(f"unsupported CRS EPSG:{code}")


# Fixed values of the registry: semi-major axis and flattening of ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, GRS80_F), "bessel": (6377397.155, 1 / 299.1528128), "airy": (6377563.396, 1 / 299.3249646), "intl": (6378388.0, 1 / 297.0)}
# Fixed values of the registry: shifts to WGS84 in metres, arc seconds (position vector) and parts per million.
SHIFTS = {
    "osgb36": (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489), "amersfoort": (565.4171, 50.3319, 465.5524, -0.398957388243134, 0.343987817378283, -1.87740163998045, 4.0725),
    "dhdn": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7), "ed50": (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0),
}


def definition(code: int) -> tuple[str, dict[str, float], str, str | None]:
    """Method, its parameters (degrees and metres), ellipsoid and datum shift of a projected CRS; an unknown code is an error."""
    if code == 2154:
        return "lcc", {"one": 49.0, "two": 44.0, "lat": 46.5, "lon": 3.0, "x": 700000.0, "y": 6600000.0}, "GRS80", None
    if code == 3035:
        return "laea", {"lat": 52.0, "lon": 10.0, "x": 4321000.0, "y": 3210000.0}, "GRS80", None
    if code == 6933:
        return "cea", {"true": 30.0, "lon": 0.0, "x": 0.0, "y": 0.0}, "WGS84", None
    if code == 28992:
        return "sterea", {"lat": 52.15616055555555, "lon": 5.38763888888889, "k": 0.9999079, "x": 155000.0, "y": 463000.0}, "bessel", "amersfoort"
    if code == 27700:
        return "tm", {"lat": 49.0, "lon": -2.0, "k": 0.9996012717, "x": 400000.0, "y": -100000.0}, "airy", "osgb36"
    if 31466 <= code <= 31469:
        zone = code - 31464
        return "tm", {"lat": 0.0, "lon": 3.0 * zone, "k": 1.0, "x": zone * 1e6 + 500000.0, "y": 0.0}, "bessel", "dhdn"
    if 23028 <= code <= 23038 or 25828 <= code <= 25838:
        return "tm", {"lat": 0.0, "lon": code % 100 * 6 - 183.0, "k": 0.9996, "x": 500000.0, "y": 0.0}, *(("intl", "ed50") if code < 24000 else ("GRS80", None))
    if 7846 <= code <= 7859:
        return "tm", {"lat": 0.0, "lon": (code - 7800) * 6 - 183.0, "k": 0.9996, "x": 500000.0, "y": 1e7}, "GRS80", None
    raise ValueError(f"unsupported CRS EPSG:{code}")


def _meridian_northing(lat: float, flattening: float) -> float:
    """Northing of a latitude on the central meridian over the semi-major axis, by Krueger's forward series."""
    n = flattening / (2 - flattening)
    e = math.sqrt(2 * flattening - flattening**2)
    phi = math.radians(lat)
    chi = math.atan(math.sinh(math.asinh(math.tan(phi)) - e * math.atanh(e * math.sin(phi))))
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    return (1 + n**2 / 4 + n**4 / 64) / (1 + n) * (chi + sum(a * math.sin(2 * k * chi) for k, a in enumerate(alpha, 1)))


def _authalic(flattening: float):
    """q of a latitude in radians, q at the pole, and the series from authalic to geodetic latitude."""
    e2 = 2 * flattening - flattening**2
    e = math.sqrt(e2)
    if not e:
        return lambda phi: 2 * math.sin(phi), 2.0, (0.0, 0.0, 0.0)
    q = lambda phi: (1 - e2) * (math.sin(phi) / (1 - e2 * math.sin(phi) ** 2) + math.atanh(e * math.sin(phi)) / e)
    return q, q(math.pi / 2), (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)


def _geodetic(beta: str, series: tuple[float, float, float]) -> Column:
    b = F.col(beta)
    return b + F.sin(b * 2) * series[0] + F.sin(b * 4) * series[1] + F.sin(b * 6) * series[2]


def _steps(rows: DataFrame, count: int, make) -> DataFrame:
    """Fixed-point steps of a latitude in column _phi, a projection each, so that expressions stay small."""
    for _ in range(count):
        rows = rows.withColumn("_phi", make(F.col("_phi")))
    return rows


def _unprojected(rows: DataFrame, method: str, p: dict[str, float], a: float, f: float) -> DataFrame:
    """Adds _lam (from the central meridian) and _phi in radians to rows with _e and _n, metres from the false origin."""
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    east, north = F.col("_e"), F.col("_n")
    if method == "lonlat":
        return rows.withColumns({"_lam": F.radians("_e"), "_phi": F.radians("_n")})
    if method == "lcc":
        east, north = (v / p.get("k", 1.0) for v in (east, north))
        t = lambda phi: math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
        m = lambda phi: math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        one, two, origin = (math.radians(p[k]) for k in ("one", "two", "lat"))
        n = math.sin(one) if one == two else (math.log(m(one)) - math.log(m(two))) / (math.log(t(one)) - math.log(t(two)))
        c = m(one) / (n * t(one) ** n)
        rho0, sign = a * c * t(origin) ** n, 1.0 if n > 0 else -1.0
        out = rows.withColumn("_t", F.pow(F.sqrt(east * east + (F.lit(rho0) - north) * (F.lit(rho0) - north)) / (a * abs(c)), F.lit(1 / n)))
        out = out.withColumns({"_lam": F.atan2(east * sign, (F.lit(rho0) - north) * sign) / n, "_phi": F.lit(math.pi / 2) - F.atan("_t") * 2})
        return _steps(out, 6, lambda phi: F.lit(math.pi / 2) - F.atan(F.col("_t") * F.pow((1 - F.sin(phi) * e) / (1 + F.sin(phi) * e), F.lit(e / 2))) * 2)
    if method == "laea":
        q, qp, series = _authalic(f)
        origin = math.radians(p["lat"])
        beta0, rq = math.asin(q(origin) / qp), a * math.sqrt(qp / 2)
        d = a * math.cos(origin) / math.sqrt(1 - e2 * math.sin(origin) ** 2) / (rq * math.cos(beta0))
        out = rows.withColumn("_r", F.sqrt(east * east / (d * d) + north * north * (d * d)))
        # beyond the projection's rim there is no point
        out = out.withColumn("_c", F.when(F.col("_r") <= 2 * rq, F.asin(F.col("_r") / (2 * rq)) * 2))
        sin, cos, r = F.sin("_c"), F.cos("_c"), F.col("_r")
        out = out.withColumn("_beta", F.when(r == 0, F.lit(beta0)).otherwise(F.asin(cos * math.sin(beta0) + north * d * sin * math.cos(beta0) / r)))
        lam = F.when(r == 0, F.lit(0.0)).otherwise(F.atan2(east * sin, r * d * math.cos(beta0) * cos - north * (d * d * math.sin(beta0)) * sin))
        return out.withColumns({"_lam": lam, "_phi": _geodetic("_beta", series)})
    if method == "cea":
        _, qp, series = _authalic(f)
        true = math.radians(p["true"])
        k0 = math.cos(true) / math.sqrt(1 - e2 * math.sin(true) ** 2)
        s = north * (2 * k0 / (a * qp))
        out = rows.withColumn("_beta", F.when(F.abs(s) <= 1, F.asin(s)))
        return out.withColumns({"_lam": east / (a * k0), "_phi": _geodetic("_beta", series)})
    if method == "sterea":
        origin = math.radians(p["lat"])
        s0 = math.sin(origin)
        r = math.sqrt(a * (1 - e2) / (1 - e2 * s0 * s0) ** 1.5 * a / math.sqrt(1 - e2 * s0 * s0))
        n = math.sqrt(1 + e2 * math.cos(origin) ** 4 / (1 - e2))
        w1 = ((1 + s0) / (1 - s0) * ((1 - e * s0) / (1 + e * s0)) ** e) ** n
        low = (w1 - 1) / (w1 + 1)
        c = (n + s0) * (1 - low) / ((n - s0) * (1 + low))
        chi0 = math.asin((c * w1 - 1) / (c * w1 + 1))
        g, h = 2 * r * p["k"] * math.tan(math.pi / 4 - chi0 / 2), 4 * r * p["k"] * math.tan(chi0) + 2 * r * p["k"] * math.tan(math.pi / 4 - chi0 / 2)
        out = rows.withColumn("_i", F.atan2(east, north + h)).withColumn("_j", F.atan2(east, F.lit(g) - north) - F.col("_i"))
        out = out.withColumn("_chi", F.atan((north - east * F.tan(F.col("_j") / 2)) / (2 * r * p["k"])) * 2 + chi0)
        out = out.withColumn("_psi", F.log((1 + F.sin("_chi")) / ((1 - F.sin("_chi")) * c)) / (2 * n)).withColumn("_phi", F.atan(F.exp("_psi")) * 2 - math.pi / 2)
        isometric = lambda phi: F.log(F.tan(phi / 2 + math.pi / 4)) + F.log((1 - F.sin(phi) * e) / (1 + F.sin(phi) * e)) * (e / 2)
        out = _steps(out, 5, lambda phi: phi - (isometric(phi) - F.col("_psi")) * F.cos(phi) * (1 - F.sin(phi) * F.sin(phi) * e2) / (1 - e2))
        return out.withColumn("_lam", (F.col("_j") + F.col("_i") * 2) / n)
    if method == "aea":
        q, qp, series = _authalic(f)
        m = lambda phi: math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        one, two, origin = (math.radians(p[k]) for k in ("one", "two", "lat"))
        n = math.sin(one) if one == two else (m(one) ** 2 - m(two) ** 2) / (q(two) - q(one))
        c = m(one) ** 2 + n * q(one)
        rho0, sign = a * math.sqrt(c - n * q(origin)) / n, 1.0 if n > 0 else -1.0
        down = F.lit(rho0) - north
        s = (F.lit(c) - (east * east + down * down) * (n / a) ** 2) / (n * qp)
        out = rows.withColumn("_beta", F.when(F.abs(s) <= 1 + 1e-12, F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))))
        return out.withColumns({"_lam": F.atan2(east * sign, down * sign) / n, "_phi": _geodetic("_beta", series)})
    if method in ("stere", "merc"):
        if method == "merc":
            true = math.radians(p.get("true", 0.0))
            k0 = p["k"] * math.cos(true) / math.sqrt(1 - e2 * math.sin(true) ** 2)
            out, sign = rows.withColumns({"_lam": east / (a * k0), "_psi": north / (a * k0)}), 1.0
        else:
            sign = math.copysign(1.0, p["lat"])
            if "true" in p and abs(abs(p["true"]) - 90) > 1e-9:
                phi = math.radians(abs(p["true"]))
                t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
                scale = t / (a * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2))
            else:
                scale = math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) / (2 * a * p["k"])
            out = rows.withColumns({"_lam": F.atan2(east, -north * sign), "_psi": -F.log(F.greatest(F.sqrt(east * east + north * north) * scale, F.lit(1e-300)))})
        out = out.withColumn("_phi", F.atan(F.sinh("_psi")))
        out = _steps(out, 6, lambda phi: F.atan(F.sinh(F.col("_psi") + F.log((1 + F.sin(phi) * e) / (1 - F.sin(phi) * e)) * (e / 2))))
        return out.withColumn("_phi", F.col("_phi") * sign)
    third = f / (2 - f)
    big = a * (1 + third**2 / 4 + third**4 / 64) / (1 + third)
    beta = (third / 2 - 2 * third**2 / 3 + 37 * third**3 / 96 - third**4 / 360, third**2 / 48 + third**3 / 15 - 437 * third**4 / 1440, 17 * third**3 / 480 - 37 * third**4 / 840, 4397 * third**4 / 161280)
    xi, eta = F.col("_xi"), F.col("_eta")
    out = rows.withColumns({"_xi": north / (p["k"] * big) + a * _meridian_northing(p["lat"], f) / big, "_eta": east / (p["k"] * big)})
    one, two = xi, eta
    for k, b in enumerate(beta, 1):
        one = one - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
        two = two - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
    out = out.withColumns({"_xi1": one, "_eta1": two}).withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    out = out.withColumns({"_lam": F.atan2(F.sinh("_eta1"), F.cos("_xi1")), "_psi": F.log((1 + F.sin("_chi")) / (1 - F.sin("_chi"))) / 2, "_phi": F.col("_chi")})
    return _steps(out, 5, lambda phi: F.atan(F.sinh(F.col("_psi") + F.log((1 + F.sin(phi) * e) / (1 - F.sin(phi) * e)) * (e / 2))))


def _shifted(rows: DataFrame, a: float, f: float, shift: tuple[float, ...]) -> DataFrame:
    """_lon and _lat in degrees on WGS84 from _lon and _lat on another datum, through geocentric coordinates."""
    e2, seconds = 2 * f - f * f, math.pi / 648000
    tx, ty, tz, rx, ry, rz, ppm = (*shift[:3], *(s * seconds for s in shift[3:6]), 1 + shift[6] * 1e-6)
    out = rows.withColumns({"_lam": F.radians("_lon"), "_phi": F.radians("_lat")})
    out = out.withColumn("_nu", F.lit(a) / F.sqrt(1 - F.sin("_phi") * F.sin("_phi") * e2))
    out = out.withColumns({"_x": F.col("_nu") * F.cos("_phi") * F.cos("_lam"), "_y": F.col("_nu") * F.cos("_phi") * F.sin("_lam"), "_z": F.col("_nu") * (1 - e2) * F.sin("_phi")})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    out = out.withColumns({"_x": (x - y * rz + z * ry) * ppm + tx, "_y": (x * rz + y - z * rx) * ppm + ty, "_z": (z - x * ry + y * rx) * ppm + tz})
    wa, wf = ELLIPSOIDS["WGS84"]
    we2 = 2 * wf - wf * wf
    out = out.withColumn("_p", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).withColumn("_phi", F.atan2(F.col("_z"), F.col("_p") * (1 - we2)))
    out = _steps(out, 4, lambda phi: F.atan2(F.col("_z") + F.sin(phi) * (we2 * wa) / F.sqrt(1 - F.sin(phi) * F.sin(phi) * we2), F.col("_p")))
    return out.withColumns({"_lon": F.degrees(F.atan2(F.col("_y"), F.col("_x"))), "_lat": F.degrees("_phi")})


def with_lonlat(rows: DataFrame, code: int | str, x: str = "x", y: str = "y", strict: bool = False, failures: Observation | None = None) -> DataFrame:
    """Adds lon and lat (WGS84 degrees) of projected coordinates, by EPSG code, PROJ string or well-known text.

    Where the inverse is not finite or off the globe both are null; such rows are counted in `failures` (as `failed`), if given,
    and with strict they are an error. Missing coordinates are no failure.
    """
    staged, said = False, crs_text.parse(code) if isinstance(code, str) else code
    code, name = said, f"EPSG:{said}" if isinstance(said, int) else str(code)
    try:
        if not isinstance(code, int):
            raise ValueError(name)
        lon, lat = inverse(code, F.col(x), F.col(y))
        out = rows.withColumns({"_lon": lon, "_lat": lat})
    except ValueError:
        staged, unit = True, 1.0
        if isinstance(code, int):
            method, p, ellipsoid, shift = definition(code)
            (a, f), shift = ELLIPSOIDS[ellipsoid], SHIFTS[shift] if shift else None
        else:
            method, p, a, f, shift, unit = code.method, code.p, code.a, code.f, code.shift, code.unit
        out = _unprojected(rows.withColumns({"_e": F.col(x) * unit - p["x"], "_n": F.col(y) * unit - p["y"]}), method, p, a, f)
        out = out.withColumns({"_lon": F.degrees("_lam") + p["lon"], "_lat": F.degrees("_phi")})
        if shift:
            out = _shifted(out, a, f, shift)
    good = F.col("_lat").between(-90, 90) & ~F.isnan("_lon") & (F.abs("_lon") < F.lit(float("inf")))
    failed = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.coalesce(good, F.lit(False))
    lon, lat = F.when(good, F.pmod(F.col("_lon") + 180, F.lit(360.0)) - 180), F.when(good, F.col("_lat"))
    if strict:  # in both, so that no filter on one of them goes before the error
        wrong = F.raise_error(F.concat(F.lit(f"{name} has no point at "), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))).cast("double")
        lon, lat = (F.when(failed, wrong).otherwise(v) for v in (lon, lat))
    if failures is not None or staged:
        # counted in any case where stages follow one another: a filter on the result would otherwise be put before the first stage, and
        # with it an expression that doubles with each
        out = out.withColumn("_failed", failed).observe(failures or f"failed-{uuid.uuid4().hex}", F.count_if("_failed").alias("failed"))
    return out.withColumns({"lon": lon, "lat": lat}).select(*[c for c in rows.columns if c not in ("lon", "lat")], "lon", "lat")
