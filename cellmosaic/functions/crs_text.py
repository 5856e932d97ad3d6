"""Coordinate reference systems from PROJ strings and well-known text, as parameters and not by a list of codes.

What can't be honoured is refused: grid shifts, unknown datums without a shift of their own, other prime meridians, axes and units of
angle, and projections that the library has not.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

# Fixed values of the registry: ellipsoids by their PROJ names, semi-major axis and flattening.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, 1 / 298.257222101), "bessel": (6377397.155, 1 / 299.1528128), "airy": (6377563.396, 1 / 299.3249646), "intl": (6378388.0, 1 / 297.0),
    "krass": (6378245.0, 1 / 298.3), "clrk66": (6378206.4, 1 - 6356583.8 / 6378206.4), "sphere": (6370997.0, 0.0),
}
# Fixed values of the registry: datums that imply an ellipsoid and a shift to WGS84 (metres, arc seconds, parts per million).
DATUMS = {
    "WGS84": ("WGS84", None), "NAD83": ("GRS80", None), "ETRS89": ("GRS80", None), "OSGB36": ("airy", (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)), "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
}
_UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}


@dataclass(frozen=True)
class Definition:
    """Method, its parameters (degrees and metres), semi-major axis, flattening, shift to WGS84, and metres of a unit."""

    method: str
    p: dict[str, float]
    a: float
    f: float
    shift: tuple[float, ...] | None = None
    unit: float = 1.0


def _refuse(what: str):
    raise ValueError(f"unsupported CRS: {what}")


def _shift(values: list[float]) -> tuple[float, ...] | None:
    if len(values) not in (3, 7):
        _refuse(f"a shift of {len(values)} parameters")
    return tuple([*values, *[0.0] * (7 - len(values))]) if any(values) else None


def _made(method: str, p: dict[str, float], a: float, f: float, shift, unit: float) -> Definition:
    """A definition whose parameters are there and within their range."""
    if not (a > 0 and 0 <= f < 1 and unit > 0 and all(math.isfinite(v) for v in (a, f, unit, *p.values()))):
        _refuse("parameters out of range")
    if method in ("lcc", "aea") and abs(p["one"] + p["two"]) < 1e-10:
        _refuse("standard parallels that cancel out")
    if method == "stere" and abs(abs(p["lat"]) - 90) > 1e-9:
        _refuse("a stereographic projection that is neither polar nor sterea")
    return Definition(method, p, a, f, shift, unit)


def from_proj(text: str) -> Definition:
    """A PROJ string, as +proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80."""
    given = dict((k, v) for k, _, v in (t.lstrip("+").partition("=") for t in text.split()))
    kind = given.get("proj") or _refuse("no +proj")
    if given.get("nadgrids", "@null") != "@null":
        _refuse("grid shifts; give +towgs84 if an approximation will do")
    if given.get("pm", "0").lower() not in ("0", "0.0", "greenwich"):
        _refuse("another prime meridian")
    if given.get("axis", "enu") != "enu" or given.get("geoidgrids"):
        _refuse("axes other than east, north, up, and geoids")
    shift, ellipsoid = None, given.get("ellps", "WGS84" if "datum" not in given else None)
    if "datum" in given:
        if given["datum"] not in DATUMS:
            _refuse(f"datum {given['datum']}")
        ellipsoid, shift = DATUMS[given["datum"]]
    if ellipsoid not in ELLIPSOIDS:
        _refuse(f"ellipsoid {ellipsoid}")
    a, f = ELLIPSOIDS[ellipsoid]
    if "R" in given:
        a, f = float(given["R"]), 0.0
    if "a" in given:
        a = float(given["a"])
        f = 1 / float(given["rf"]) if "rf" in given else float(given["f"]) if "f" in given else 1 - float(given["b"]) / a if "b" in given else 0.0
    if "towgs84" in given:
        shift = _shift([float(v) for v in given["towgs84"].split(",")])
    if "to_meter" in given:
        unit = float(given["to_meter"])
    else:
        unit = _UNITS.get(given.get("units", "m")) or _refuse(f"units {given['units']}")
    n = lambda key, default=0.0: float(given.get(key, default))
    p = {"lat": n("lat_0"), "lon": n("lon_0"), "x": n("x_0"), "y": n("y_0"), "k": float(given.get("k_0", given.get("k", 1.0)))}
    if kind in ("longlat", "latlong", "lonlat", "latlon"):
        return _made("lonlat", {"lon": 0.0, "x": 0.0, "y": 0.0}, a, f, shift, 1.0)
    if kind == "utm":
        zone = int(given.get("zone", "0"))
        if not 1 <= zone <= 60:
            _refuse("a UTM zone that isn't 1 to 60")
        return _made("tm", {"lat": 0.0, "lon": zone * 6 - 183.0, "k": 0.9996, "x": 5e5, "y": 1e7 if "south" in given else 0.0}, a, f, shift, unit)
    if kind in ("tmerc", "etmerc"):
        return _made("tm", p, a, f, shift, unit)
    if kind in ("lcc", "aea"):
        one = n("lat_1", given.get("lat_0", 0.0))
        p |= {"one": one, "two": n("lat_2", one)} | ({} if "lat_0" in given or kind == "aea" else {"lat": one if "lat_2" not in given else 0.0})
        return _made(kind, p, a, f, shift, unit)
    if kind in ("laea", "sterea"):
        return _made(kind, p, a, f, shift, unit)
    if kind == "cea":
        return _made("cea", p | {"true": n("lat_ts")}, a, f, shift, unit)
    if kind == "stere":
        return _made("stere", p | ({"true": n("lat_ts")} if "lat_ts" in given else {}), a, f, shift, unit)
    if kind in ("merc", "webmerc"):
        return _made("merc", p | {"true": n("lat_ts")}, a, 0.0 if kind == "webmerc" else f, shift, unit)
    return _refuse(f"projection {kind}")


# --- well-known text ------------------------------------------------------------------------------------------------------

_WKT = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z_][A-Za-z0-9_]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


def parse_wkt(text: str) -> list:
    """Nested lists: a keyword in capitals, then its values, texts, numbers or such lists."""
    at, stack, pending = 0, [[]], None
    while at < len(text.rstrip()):
        m = _WKT.match(text, at)
        if not m:
            _refuse(f"well-known text at {text[at : at + 20]!r}")
        at = m.end()
        quoted, word, number, mark = m.groups()
        if mark in ("[", "("):
            if pending is None or len(stack) > 50:
                _refuse("well-known text out of form")
            own = [pending]
            stack[-1].append(own)
            stack.append(own)
            pending = None
            continue
        if pending is not None:
            stack[-1].append(pending)
            pending = None
        if mark in ("]", ")"):
            if len(stack) == 1:
                _refuse("well-known text out of form")
            stack.pop()
        elif quoted is not None:
            stack[-1].append(quoted[1:-1].replace('""', '"'))
        elif word is not None:
            pending = word.upper()
        elif number is not None:
            stack[-1].append(float(number))
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        _refuse("well-known text out of form")
    return stack[0][0]


def _find(node: list, *names: str, deep: bool = True) -> list | None:
    for child in node[1:]:
        if isinstance(child, list):
            if child[0] in names:
                return child
            if deep and (found := _find(child, *names)):
                return found
    return None


_KNOWN_DATUM = re.compile(r"wgs.?(?:19)?84|world.geodetic.system.1984|nad.?(?:19)?83|north.american.(?:datum.)?1983|etrs.?(?:19)?89|european.terrestrial|gda.?(?:19|20)?(?:94|20)|geocentric.datum.of.australia", re.I)
# Fixed values of the formats: methods by their names without separators, and parameters by theirs.
_METHODS = {
    "transversemercator": "tm", "lambertconformalconic2sp": "lcc", "lambertconicconformal2sp": "lcc", "lambertconformalconic1sp": "lcc", "lambertconicconformal1sp": "lcc", "lambertconformalconic": "lcc", "albersconicequalarea": "aea", "albersequalarea": "aea", "albers": "aea",
    "lambertazimuthalequalarea": "laea", "cylindricalequalarea": "cea", "lambertcylindricalequalarea": "cea", "obliquestereographic": "sterea", "doublestereographic": "sterea", "polarstereographic": "stere", "polarstereographicvarianta": "stere", "polarstereographicvariantb": "stere",
    "mercator1sp": "merc", "mercator2sp": "merc", "mercator": "merc", "mercatorvarianta": "merc", "mercatorvariantb": "merc", "popularvisualisationpseudomercator": "webmerc", "mercatorauxiliarysphere": "webmerc",
}
_PARAMETERS = {
    "latitudeoforigin": "lat", "latitudeofnaturalorigin": "lat", "latitudeoffalseorigin": "lat", "latitudeofcenter": "lat", "latitudeofprojectioncentre": "lat", "centralmeridian": "lon", "longitudeofcenter": "lon", "longitudeofnaturalorigin": "lon", "longitudeoffalseorigin": "lon", "longitudeoforigin": "lon",
    "longitudeofprojectioncentre": "lon", "straightverticallongitudefrompole": "lon", "standardparallel1": "one", "latitudeof1ststandardparallel": "one", "standardparallel2": "two", "latitudeof2ndstandardparallel": "two", "latitudeofstandardparallel": "one", "scalefactor": "k",
    "scalefactoratnaturalorigin": "k", "falseeasting": "x", "eastingatfalseorigin": "x", "falsenorthing": "y", "northingatfalseorigin": "y", "auxiliaryspheretype": "sphere",
}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def epsg_of(text: str) -> int | None:
    """The code that well-known text names as its own, if it does."""
    found = _find(parse_wkt(text), "AUTHORITY", "ID", deep=False)
    return int(float(found[2])) if found and len(found) > 2 and str(found[1]).upper() == "EPSG" else None


def from_wkt(text: str) -> Definition:
    """Well-known text of either version, of a projected or a geographic CRS."""
    root = parse_wkt(text)
    if root[0] in ("BOUNDCRS", "COMPD_CS", "COMPOUNDCRS"):
        root = _find(root, "PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS", "GEODCRS") or _refuse(root[0])
    if root[0] not in ("PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS", "GEODCRS", "GEODETICCRS", "GEOGRAPHICCRS", "PROJECTEDCRS"):
        _refuse(root[0])
    sphere = _find(root, "SPHEROID", "ELLIPSOID") or _refuse("no ellipsoid")
    a, f = float(sphere[2]), 1 / float(sphere[3]) if float(sphere[3]) else 0.0
    given = _find(root, "TOWGS84")
    shift = _shift([float(v) for v in given[1:]]) if given else None
    datum = _find(root, "DATUM", "ENSEMBLE", "GEODETICDATUM") or _refuse("no datum")
    if given is None and not _KNOWN_DATUM.search(re.sub(r"^D_", "", str(datum[1]))):
        _refuse(f"datum {datum[1]} without a shift")
    meridian = _find(root, "PRIMEM", "PRIMEMERIDIAN")
    if meridian and abs(float(meridian[2])) > 1e-12:
        _refuse("another prime meridian")
    if root[0].startswith("GEO"):
        return _made("lonlat", {"lon": 0.0, "x": 0.0, "y": 0.0}, a, f, shift, 1.0)
    conversion = _find(root, "CONVERSION", deep=False) or root
    named = _find(conversion, "PROJECTION", "METHOD", deep=False) or _refuse("no projection")
    method = _METHODS.get(_plain(str(named[1]))) or _refuse(f"projection {named[1]}")
    # the unit of the projected axes, and of the parameters in WKT 1: the last one at the top
    units = [c for c in root[1:] if isinstance(c, list) and c[0] in ("UNIT", "LENGTHUNIT")]
    axis = next((_find(c, "LENGTHUNIT", "UNIT") for c in root[1:] if isinstance(c, list) and c[0] == "AXIS" and _find(c, "LENGTHUNIT", "UNIT")), None)
    unit = float((units[-1] if units else axis or [None, None, 1.0])[2])
    angles = _find(_find(root, "GEOGCS", "BASEGEOGCRS", "BASEGEODCRS") or root, "ANGLEUNIT", "UNIT")
    if angles and abs(float(angles[2]) - math.pi / 180) > 1e-9:
        _refuse("angles in other units than degrees")
    p: dict[str, float] = {}
    for c in conversion[1:]:
        if isinstance(c, list) and c[0] == "PARAMETER":
            name = _PARAMETERS.get(_plain(str(c[1]))) or _refuse(f"parameter {c[1]}")
            own = _find(c, "LENGTHUNIT", "UNIT")
            # lengths of WKT 1 are in the unit of the axes, those of WKT 2 say theirs
            p[name] = float(c[2]) * ((float(own[2]) if own else unit) if name in ("x", "y") else 1.0)
    p = {"lat": 0.0, "lon": 0.0, "x": 0.0, "y": 0.0, "k": 1.0} | p
    if p.pop("sphere", 0.0) not in (0.0,):
        _refuse("another auxiliary sphere")
    if method in ("lcc", "aea"):
        p["one"] = p.get("one", p["lat"])
        p["two"] = p.get("two", p["one"])
    if method in ("cea", "merc", "webmerc"):
        p["true"] = p.pop("one", 0.0)
    if method == "stere":
        true = p.pop("one", None)
        if _plain(str(named[1])) == "polarstereographic" and true is None and abs(abs(p["lat"]) - 90) > 1e-9:
            true = p["lat"]  # WKT 1 gives the true latitude as the origin
        if true is not None:
            p |= {"true": true, "lat": math.copysign(90.0, true)}
    if method == "webmerc":
        method, f = "merc", 0.0
    return _made(method, p, a, f, shift, unit)


def parse(text: str) -> Definition | int:
    """A PROJ string, well-known text, or a code as EPSG:3035; well-known text that names a code of the library's own is that code."""
    text = text.strip()
    if m := re.fullmatch(r"(?i)(?:urn:ogc:def:crs:)?epsg:+(\d+)", text):
        return int(m[1])
    if text.startswith("+"):
        return from_proj(text)
    return from_wkt(text)
