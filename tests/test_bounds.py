"""Certified bounds of projected rectangles against points of them, and what they leave unread."""

from __future__ import annotations

import numpy as np
import pytest

from cellmosaic.functions import bounds, crs
from cellmosaic.sources import geotiff

#: Code, and the range of eastings and northings that rectangles are taken from.
PLACES = [
    (4326, (-200, 200), (-89, 89)), (3857, (-2.1e7, 2.1e7), (-2e7, 2e7)), (5070, (-2.4e6, 2.3e6), (2e5, 3.2e6)), (3338, (-1.5e6, 1.5e6), (3e5, 2.4e6)), (32610, (1e5, 9e5), (1e5, 9e6)), (32733, (1e5, 9e5), (1e6, 9.9e6)),
    (3413, (-4e6, 4e6), (-4e6, 4e6)), (3031, (-4e6, 4e6), (-4e6, 4e6)), (2154, (-4e5, 1.5e6), (5.5e6, 7.5e6)), (3035, (2e6, 7e6), (1e6, 5.5e6)), (6933, (-1.7e7, 1.7e7), (-7e6, 7e6)), (27700, (0, 7e5), (0, 1.2e6)), (25832, (2e5, 8e5), (5e6, 6.5e6)), (7855, (2e5, 8e5), (5e6, 9e6)),
]


@pytest.mark.parametrize("code, xs, ys", PLACES)
def test_bounds_enclose(spark, code, xs, ys):
    """Every point of rectangles of all sizes, and the width of small ones' bounds."""
    rng = np.random.default_rng(code)
    size = np.array([(xs[1] - xs[0]) * 10.0 ** -rng.uniform(0.3, 5) for _ in range(60)])
    west, south = rng.uniform(xs[0], xs[1] - size), rng.uniform(ys[0], np.maximum(ys[1] - size, ys[0]))
    east, north = west + size, south + size * rng.uniform(0.2, 1, 60)
    left, low, right, high, proven = bounds.lonlat_bounds(code, west, south, east, north)
    steps = np.linspace(0, 1, 13)
    points = [(k, float(west[k] + (east[k] - west[k]) * a), float(south[k] + (north[k] - south[k]) * b)) for k in range(60) for a in steps for b in steps]
    got = crs.with_lonlat(spark.createDataFrame(points, "k int, x double, y double"), code).filter("lat IS NOT NULL").collect()
    assert len(got) > 5000 and proven.mean() > 0.8
    for r in got:
        k = r["k"]
        assert low[k] <= r["lat"] <= high[k] and any(left[k] <= r["lon"] + turn <= right[k] for turn in (0, 360, -360)), (k, r)
    seen = {k: [(r["lon"], r["lat"]) for r in got if r["k"] == k] for k in range(60)}
    for k in np.flatnonzero(proven & (size < (xs[1] - xs[0]) / 300)):
        lat = [p[1] for p in seen[k]]
        if lat and max(np.abs(lat)) < 85:
            assert high[k] - low[k] < 1.3 * (max(lat) - min(lat)) + 0.1


def test_unknown_ones_have_the_globe():
    for code, box in ((1, (0, 0, 1, 1)), (28992, (1e5, 4e5, 1.1e5, 4.1e5)), (32610, (5e5, np.nan, 6e5, 1.0)), (3035, (-9e7, 0, 9e7, 1e6))):
        *got, proven = bounds.lonlat_bounds(code, *box)
        assert tuple(float(g[0]) for g in got) == bounds.GLOBE and not proven[0]
        assert bounds.meets(code, box, (10, 10, 11, 11))[0]
    left, low, right, high, proven = bounds.lonlat_bounds(3413, -1e5, -1e5, 1e5, 1e5)
    assert proven[0] and high[0] == 90 and 85 < low[0] and right[0] - left[0] == 360
    left, low, right, high, _ = bounds.lonlat_bounds(4326, 170, 0, 190, 5)
    assert left[0] < 170 < 190 < right[0] and bounds.meets(4326, (170, 0, 190, 5), (-175, 1, -172, 2))[0] and not bounds.meets(4326, (170, 0, 190, 5), (-165, 1, -150, 2))[0]


@pytest.mark.parametrize("code, origin, pixel, box", [(5070, (-500_000, 2_000_000), 1000, (-100.5, 39.2, -99.5, 39.9)), (3413, (-300_000, 200_000), 2000, (-60.0, 87.5, -20.0, 88.5)), (3035, (4_000_000, 3_400_000), 1000, (9.0, 52.0, 10.0, 53.0)), (32633, (400_000, 5_900_000), 500, (14.5, 52.5, 15.0, 52.8))])
def test_a_box_in_degrees_prunes_projected_chunks(spark, tmp_path, code, origin, pixel, box):
    from cellmosaic.plans.options import ScanOptions
    from cellmosaic.sources import scan

    values = np.arange(256 * 256, dtype="f4").reshape(256, 256)
    path = str(tmp_path / "p.tif")
    open(path, "wb").write(geotiff.write_geotiff(values, origin, (pixel, pixel), tile=16, epsg=code))
    every = scan.samples(spark, path, ScanOptions(grid="healpix")).collect()
    west, south, east, north = box
    want = {(r["col"], r["row"]) for r in every if west <= r["lon"] <= east and south <= r["lat"] <= north}
    got = scan.samples(spark, path, ScanOptions(grid="healpix", bbox=box)).collect()
    assert {(r["col"], r["row"]) for r in got} == want and want
    reader = geotiff.PixelReader({"path": path, "lonlat_bbox": ",".join(map(str, box)), "target_chunks": "1"})
    read = {k for p in reader.partitions() for k in range(p.first, p.last + 1)}
    needed = {(r // 16) * 16 + c // 16 for c, r in want}
    assert needed <= read and len(read) <= len(needed) + 40 < 256
