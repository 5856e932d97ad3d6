"""PROJ strings and well-known text against codes of the same systems, and what is refused."""

from __future__ import annotations

import numpy as np
import pytest

from cellmosaic.functions import crs, crs_text

WGS = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
GRS = 'GEOGCS["RGF93",DATUM["European_Terrestrial_Reference_System_1989",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
LCC = f'PROJCS["Lambert-93",{GRS},PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",49],PARAMETER["standard_parallel_2",44],PARAMETER["latitude_of_origin",46.5],PARAMETER["central_meridian",3],PARAMETER["false_easting",700000],PARAMETER["false_northing",6600000],UNIT["metre",1]]'
LAEA2 = 'PROJCRS["x",BASEGEOGCRS["ETRS89",DATUM["European Terrestrial Reference System 1989",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["c",METHOD["Lambert Azimuthal Equal Area",ID["EPSG",9820]],PARAMETER["Latitude of natural origin",52,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",10,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["False easting",4321000,LENGTHUNIT["metre",1]],PARAMETER["False northing",3210000,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["(E)",east],AXIS["(N)",north],LENGTHUNIT["metre",1]]'
FEET = f'PROJCS["f",{WGS},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-123],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",{500000 / 0.3048!r}],PARAMETER["false_northing",0],UNIT["foot",0.3048]]'

#: Text, a code of the same system, how many of the text's units a metre of it is, and where points are taken.
PAIRS = [
    ("+proj=utm +zone=10 +datum=WGS84 +units=m +no_defs", 32610, 1, (5e5, 4.2e6)), ("+proj=utm +zone=33 +south +datum=WGS84", 32733, 1, (5e5, 7e6)), (FEET, 32610, 1 / 0.3048, (5e5, 4.2e6)),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83 +units=m", 5070, 1, (1e5, 1.5e6)), ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=GRS80 +units=us-ft", 5070, 3937 / 1200, (1e5, 1.5e6)),
    ("+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80 +towgs84=0,0,0,0,0,0,0", 2154, 1, (7e5, 6.6e6)), (LCC, 2154, 1, (7e5, 6.6e6)), (LAEA2, 3035, 1, (4.3e6, 3.2e6)), ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 3035, 1, (4.3e6, 3.2e6)),
    ("+proj=cea +lat_ts=30 +lon_0=0 +datum=WGS84", 6933, 1, (1e6, 1e6)), ("+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84", 3413, 1, (3e5, -2e6)), ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +datum=WGS84", 3031, 1, (3e5, -2e6)),
    ("+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null", 3857, 1, (1e6, 5e6)), ("+proj=webmerc +datum=WGS84", 3857, 1, (1e6, 5e6)), ("+proj=longlat +datum=WGS84", 4326, 1, (10, 45)),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489", 27700, 1, (4e5, 3e5)), ("EPSG:3035", 3035, 1, (4.3e6, 3.2e6)),
]


@pytest.mark.parametrize("text, code, unit, around", PAIRS)
def test_texts_agree_with_codes(spark, text, code, unit, around):
    rng = np.random.default_rng(1)
    spread = 5.0 if code == 4326 else 2e5
    points = [(float(around[0] + a), float(around[1] + b)) for a, b in rng.uniform(-spread, spread, (60, 2))]
    want = crs.with_lonlat(spark.createDataFrame(points, "x double, y double"), code).collect()
    got = crs.with_lonlat(spark.createDataFrame([(x * unit, y * unit) for x, y in points], "x double, y double"), text).filter("lat IS NOT NULL").collect()
    assert len(got) == 60
    for g, w in zip(got, want, strict=True):
        assert (g["lon"], g["lat"]) == (pytest.approx(w["lon"], abs=2e-8), pytest.approx(w["lat"], abs=2e-8))


@pytest.mark.parametrize("text", [
    "+proj=utm +zone=10 +datum=NAD27", "+proj=utm +zone=61 +datum=WGS84", "+proj=lcc +lat_1=10 +lat_2=-10 +datum=WGS84", "+proj=longlat +nadgrids=x.gsb", "+proj=tmerc +pm=paris +datum=WGS84", "+proj=robin +datum=WGS84", "+proj=stere +lat_0=45 +datum=WGS84", "+datum=WGS84",
    "+proj=tmerc +axis=neu +datum=WGS84", "+proj=tmerc +units=parsec +datum=WGS84", "+proj=tmerc +a=-1", "+proj=tmerc +towgs84=1,2 +ellps=bessel", LCC.replace("European_Terrestrial_Reference_System_1989", "Somewhere"), LCC.replace("Lambert_Conformal_Conic_2SP", "Robinson"), LCC[:-1], "PROJCS[", "x", LCC.replace("latitude_of_origin", "azimuth"),
    LCC.replace("0.0174532925199433", "0.015707963267949"), 'PROJCS["' + "A[" * 200,
])
def test_what_cannot_be_honoured_is_refused(text):
    with pytest.raises(ValueError):
        crs_text.parse(text)


def test_details_of_text():
    d = crs_text.from_wkt(LCC.replace("],PRIMEM", ',TOWGS84[1,2,3,4,5,6,7]],PRIMEM', 1).replace('["GRS 1980",6378137,298.257222101]]', '["GRS 1980",6378137,298.257222101],TOWGS84[1,2,3,4,5,6,7]]'))
    assert d.shift == (1, 2, 3, 4, 5, 6, 7) and d.method == "lcc"
    assert crs_text.epsg_of(LCC[:-1] + ',AUTHORITY["EPSG","2154"]]') == 2154 and crs_text.epsg_of(LCC) is None
    assert crs_text.from_proj("+proj=lcc +lat_1=40 +lat_0=40 +lon_0=3 +k_0=0.99 +ellps=GRS80").p["k"] == 0.99
    assert crs_text.parse_wkt('A["x ""y""",1.5E-3,B[c]]') == ["A", 'x "y"', 0.0015, ["B", "C"]]
    stere = f'PROJCS["p",{WGS},PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",70],PARAMETER["central_meridian",-45],PARAMETER["scale_factor",1],UNIT["metre",1]]'
    assert crs_text.from_wkt(stere).p["true"] == 70 and crs_text.from_wkt(stere).p["lat"] == 90
