from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import crs, h3, h3bits, healpix, s2, wkb

LON, LAT = -122.4194, 37.7749


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_ids(spark):
    row = one(spark, healpix.lonlat_to_cell(F.lit(LON), F.lit(LAT), 8), s2.lonlat_to_cell(F.lit(LON), F.lit(LAT), 8), s2.lonlat_to_cell(F.lit(0.0), F.lit(0.0), 30))
    assert row[0] == 0x66343
    assert row[1] & (1 << 64) - 1 == 0x8085900000000000
    assert row[2] == 0x1000000000000001


def test_staged_and_column_forms_agree(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(float(a), float(np.degrees(np.arcsin(b)))) for a, b in zip(rng.uniform(-180, 180, 300), rng.uniform(-1, 1, 300), strict=True)], "lon double, lat double")
    for depth in (0, 3, 8, 17, 29):
        rows = healpix.with_cell(points, depth).withColumn("c", healpix.lonlat_to_cell(F.col("lon"), F.col("lat"), depth)).collect()
        assert all(r["cell"] == r["c"] for r in rows)
        assert all(4 << 2 * depth <= r["cell"] < 16 << 2 * depth for r in rows)


def test_centres_lie_in_their_cells(spark):
    cells = spark.range(12 * 16).select((F.col("id") + 64).alias("cell"))
    lon, lat = healpix.center(F.col("cell"), 2)
    rows = cells.select("cell", lon.alias("lon"), lat.alias("lat"), healpix.lonlat_to_cell(lon, lat, 2).alias("again")).collect()
    assert all(r["cell"] == r["again"] for r in rows)
    a, b = healpix.centers(np.array([r["cell"] for r in rows]), 2)
    assert np.allclose(a, [r["lon"] for r in rows]) and np.allclose(b, [r["lat"] for r in rows])


def test_outside_the_globe_and_finer_parents_are_null(spark):
    row = one(spark, healpix.lonlat_to_cell(F.lit(0.0), F.lit(91.0), 3), healpix.lonlat_to_cell(F.lit(float("nan")), F.lit(0.0), 3), healpix.cell_to_parent(F.lit(100), 2, 3), s2.lonlat_to_cell(F.lit(0.0), F.lit(0.0), 31))
    assert list(row) == [None] * 4


def test_text_form(spark):
    rows = spark.createDataFrame([("66343",), (" 66343 ",), ("0X1",), ("",), ("11112222333344445",), (None,)], "t string").select(healpix.from_string(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0x66343, 0x66343, 0, 0, 0, 0]


def test_h3_bits(spark):
    c = F.lit(599686042433355775)
    row = one(spark, healpix.to_string(c), h3bits.resolution(c), h3bits.is_valid(c), h3bits.cell_to_parent(c, 4), h3bits.resolution(F.lit(0)), h3bits.cell_to_parent(c, 6))
    assert list(row) == ["85283473fffffff", 5, True, 0x8428347FFFFFFFF, -1, None]


def test_projections_invert(spark):
    row = one(spark, *crs.inverse(32610, F.lit(551130.768), F.lit(4180998.881)), *crs.inverse(5070, F.lit(0.0), F.lit(0.0)), *crs.inverse(3413, F.lit(0.0), F.lit(-2000000.0)), *crs.inverse(3857, F.lit(0.0), F.lit(0.0)))
    assert row[0] == pytest.approx(LON, abs=1e-4) and row[1] == pytest.approx(37.7749, abs=1e-3)
    assert row[2] == pytest.approx(-96) and row[3] == pytest.approx(23, abs=1e-6)
    assert row[4] == pytest.approx(-45) and 70 < row[5] < 75
    assert list(row)[6:] == pytest.approx([0, 0])
    with pytest.raises(ValueError):
        crs.inverse(1, F.lit(0.0), F.lit(0.0))


# Points of published examples: EPSG code, easting, northing, longitude, latitude, degrees of tolerance.
PUBLISHED = [
    (2154, 648237.3, 6862271.7, 2.2945, 48.8583, 2e-4),
    (3035, 3962799.45, 2999718.85, 5.0, 50.0, 1e-7),
    (3035, 4321000.0, 3210000.0, 10.0, 52.0, 1e-8),
    (6933, 0.0, 0.0, 0.0, 0.0, 1e-9),
    (28992, 155000.0, 463000.0, 5.387204, 52.155174, 4e-6),
    (27700, 651409.903, 313177.270, 1.716074, 52.657977, 1e-4),
    (25832, 500000.0, 5538630.703, 9.0, 50.0, 1e-6),
    (7855, 500000.0, 10000000.0, 147.0, 0.0, 1e-9),
]


@pytest.mark.parametrize("code, x, y, lon, lat, near", PUBLISHED)
def test_published_points(spark, code, x, y, lon, lat, near):
    row = crs.with_lonlat(spark.createDataFrame([(x, y)], "x double, y double"), code).first()
    assert row["lon"] == pytest.approx(lon, abs=near) and row["lat"] == pytest.approx(lat, abs=near)


def test_transform_failures_are_counted_or_errors(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import Observation

    rows = spark.createDataFrame([(4321000.0, 3210000.0), (5e7, 0.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    seen = Observation()
    got = crs.with_lonlat(rows, 3035, failures=seen).collect()
    assert [r["lat"] is None for r in got] == [False, True, True, True] and seen.get["failed"] == 2 and got[0].asDict().keys() == {"x", "y", "lon", "lat"}
    with pytest.raises(PySparkException, match="EPSG:3035"):
        crs.with_lonlat(rows, 3035, strict=True).collect()


def test_outlines():
    lon, lat = healpix.corners(np.arange(4 * 64, 16 * 64), 3)
    for a, b in zip(lon, lat, strict=True):
        shape = wkb.cell_outline(a, b)
        for poly in wkb.read_rings(shape):
            ring = poly[0]
            assert (ring[0] == ring[-1]).all() and np.abs(ring[:, 0]).max() <= 180 + 1e-9
            x, y = ring[:, 0], ring[:, 1]
            assert (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() > 0


def h3_ids(points, resolution):
    lat, lng = np.radians(np.array(points, dtype=float)).T
    return [f"{x:x}" for x in h3.cells(lat, lng, resolution)]


def test_h3_known_ids():
    """Ids that are public for these points."""
    assert h3_ids([(37.7752702151959, -122.418307270836)], 9) == ["8928308280fffff"] and h3_ids([(37.7752702151959, -122.418307270836)], 8) == ["8828308281fffff"]
    assert h3_ids([(37.3615593, -122.0553238)], 5) == ["85283473fffffff"] and h3_ids([(0, 0)], 5) == ["85754e67fffffff"]


def test_h3_table_follows_from_geometry():
    cell, _, back = h3.base_cell_table()
    assert list(h3.pentagons()) == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    # faces from which a pentagon's deleted axis is turned back, fixed values of the grid
    turned_back = {14: [2, 6], 24: [1, 5], 38: [3, 7], 49: [0, 9], 58: [4, 8], 63: [11, 15], 72: [12, 16], 83: [10, 19], 97: [13, 17], 107: [14, 18], 4: [], 117: []}
    assert {int(p): [f for f in range(20) if cell[f, 0, 2, 0] == p and back[f, 0, 2, 0]] for p in h3.pentagons()} == turned_back


def test_h3_cells_cover_the_globe():
    """Every cell of a resolution is met, each is small, and no pentagon has a first digit of the deleted axis."""
    rng = np.random.default_rng(1)
    lat, lng = np.arcsin(rng.uniform(-1, 1, 600_000)), rng.uniform(-np.pi, np.pi, 600_000)
    xyz = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
    for resolution, count, radius in ((0, 122, 0.23), (1, 842, 0.09), (2, 5882, 0.035)):
        ids = h3.cells(lat, lng, resolution)
        found, place = np.unique(ids, return_inverse=True)
        centre = np.stack([np.bincount(place, weights=xyz[:, k]) for k in range(3)], axis=1)
        centre /= np.linalg.norm(centre, axis=1)[:, None]
        assert len(found) == count and np.arccos(np.clip((xyz * centre[place]).sum(axis=1), -1, 1)).max() < radius
        base, first = found >> 45 & 127, found >> 42 & 7
        assert not (np.isin(base, h3.pentagons()) & (first == 1)).any()


def test_h3_centres_lie_in_their_cells():
    """Centres of cells all over the globe, those of pentagons and around them, fall into their own cells again."""
    rng = np.random.default_rng(2)
    lat, lng = np.arcsin(rng.uniform(-1, 1, 20_000)), rng.uniform(-np.pi, np.pi, 20_000)
    corners = [(*np.degrees(h3._on_sphere(2, 0, c[0])),) for c in h3.BASE_CELLS if c[1:] == (2, 0, 0)]
    near = np.radians(np.repeat(corners, 500, axis=0) + rng.normal(0, 3, (6000, 2)) * np.array([1, 1]))
    near[:, 0] = np.clip(near[:, 0], -np.pi / 2, np.pi / 2)
    lat, lng = np.r_[lat, near[:, 0]], np.r_[lng, near[:, 1]]
    for resolution in range(16):
        ids = np.unique(h3.cells(lat, lng, resolution))
        assert (h3.cells(*h3.centres(ids), resolution) == ids).all(), resolution


def test_h3_column(spark):
    rows = [(-122.418307270836, 37.7752702151959), (None, 1.0), (float("nan"), 1.0), (10.0, 91.0), (370.0, 0.0), (10.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "lon double, lat double").select(h3.lonlat_to_cell(F.col("lon"), F.col("lat"), 9)).collect()]
    assert got[0] == 0x8928308280FFFFF and got[1:4] == [None, None, None] and got[4] == got[5]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in got], "c long").select(h3bits.is_valid(F.col("c"))).collect()][0]


def test_ground_areas(spark):
    """Areas that are public to many digits."""
    from cellmosaic.functions import ground

    cases = [(0.0, 0.0, 1.0, 1.0, 12_308_463_893.975353), (0.0, 59.0, 1.0, 60.0, 6_309_805_669.030524), (0.0, 89.0, 1.0, 90.0, 108_866_681.63620767), (179.5, -1.0, -179.5, 1.0, 24_616_927_787.950706), (-180.0, -90.0, 180.0, 90.0, 510_065_621_724_088.5), (0.0, 89.999999, 0.000001, 90.0, 1.0886966872408339e-10)]
    rows = spark.createDataFrame([c[:4] for c in cases] + [(0.0, 5.0, 1.0, 5.0), (0.0, -91.0, 1.0, 0.0), (200.0, 0.0, 1.0, 1.0), (5.0, 0.0, 5.0, 1.0), (None, 0.0, 1.0, 1.0)], "w double, s double, e double, n double")
    got = [r[0] for r in rows.select(ground.rectangle_area(*[F.col(c) for c in "wsen"])).collect()]
    assert got[:6] == [pytest.approx(c[4], rel=1e-8) for c in cases] and got[6:] == [None] * 5
    total = spark.range(180).select(F.sum(ground.pixel_area(F.col("id"), 90.0, (360.0, 1.0)))).first()[0]
    assert total == pytest.approx(cases[4][4], rel=1e-12)
