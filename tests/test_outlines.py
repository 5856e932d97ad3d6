"""Outlines of H3 and S2 cells, and polygon fill of all grids and modes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import grids, h3, s2, wkb
from cellmosaic.operators import polyfill


def xyz(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def test_published_outline():
    """Vertices that are public for this cell, in their order."""
    lat, lng, count = h3.outlines(np.array([0x85283473FFFFFFF]))
    want = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.92354999630156), (37.42012867767779, -122.03773496427027), (37.33755608435299, -122.090428929044), (37.26319797461824, -122.02910130919001)]
    assert count[0] == 6 and np.degrees(np.c_[lat[0, :6], lng[0, :6]]) == pytest.approx(np.array(want), abs=1e-9)


@pytest.mark.parametrize("name, most", [("h3", 3), ("s2", 4), ("healpix", 4)])
def test_cells_tile_the_globe(name, most):
    """Areas of all cells of a level add up to the sphere, no part of a descendant is out of reach, and neighbours share their vertices."""
    own = grids.grid(name)
    ids = own.roots()
    coarse, of = ids, np.arange(len(ids))
    for level in range(most + 1):
        lon, lat, count = own.outlines(ids)
        centre, vertex, area = xyz(*own.centers(ids)), xyz(lon, lat), np.zeros(len(ids))
        for k in range(lon.shape[1]):
            a, b = vertex[:, k], vertex[:, (k + 1) % lon.shape[1]]
            dot = lambda p, q: np.einsum("ni,ni->n", p, q)
            area += 2 * np.arctan2(dot(centre, np.cross(a, b)), 1 + dot(centre, a) + dot(a, b) + dot(b, centre))
        assert area.min() > 0 and area.sum() == pytest.approx(4 * np.pi, rel=1e-9 if name != "healpix" else 1e-2)
        far = np.degrees(np.arccos(np.clip(np.einsum("ni,nki->nk", xyz(*own.centers(coarse))[of], vertex), -1, 1))).max()
        assert far <= own.reach(0) and (own.levels(ids) == level).all()
        if name == "h3":
            vertices = {tuple(v) for row, n in zip(np.round(vertex, 9), count, strict=True) for v in row[:n]}
            if level % 2 == 0:
                assert len(vertices) == 2 * len(ids) - 4  # three cells meet at each, twelve of which have five
        below = own.children(ids)
        many = np.array([len(own.children(ids[k : k + 1])) for k in range(len(ids))]) if len(ids) < 900 else np.full(len(ids), len(below) // len(ids))
        if many.sum() != len(below):
            break
        of, ids = np.repeat(of, many), below


@pytest.mark.parametrize("name", ["h3", "s2", "healpix"])
def test_points_lie_in_the_outlines_of_their_cells(name):
    rng = np.random.default_rng(4)
    own = grids.grid(name)
    lon, lat = rng.uniform(-180, 180, 3000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))
    for level in range(3, own.most + 1, 3):
        ids = own.cells(lon, lat, level)
        assert (own.levels(ids) == level).all() and (own.cells(*own.centers(ids), level) == ids).all()
        if name == "healpix":
            continue  # its sides are no great circles
        x, y, _ = own.outlines(ids)
        v, p = xyz(x, y), xyz(lon, lat)
        long = np.linalg.norm(v - np.roll(v, -1, axis=1), axis=2)
        side = np.where(long > 1e-13, np.einsum("nki,ni->nk", np.cross(v, np.roll(v, -1, axis=1)), p), 0.0)
        # above rounding, and beside H3's bends: those are no corners of its lattice
        assert (side > -1e-15 - 1e-9 * long).mean() > (0.9999 if name == "h3" else 1 - 1e-12), (level, side.min())


def test_array_and_column_forms_agree(spark):
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(-180, 180, 200), np.degrees(np.arcsin(rng.uniform(-1, 1, 200)))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "lon double, lat double")
    for name in grids.GRIDS:
        own = grids.grid(name)
        for level in (0, 5, 11):
            got = [r[0] for r in points.select(own.lonlat_to_cell(F.col("lon"), F.col("lat"), level)).collect()]
            assert own.cells(lon, lat, level).tolist() == got
            up = [r[0] for r in points.select(own.to_parent(own.lonlat_to_cell(F.col("lon"), F.col("lat"), level), level, max(0, level - 2))).collect()]
            assert (own.levels(np.array(up)) == max(0, level - 2)).all()


def test_columns_of_outlines(spark):
    ids = [0x85283473FFFFFFF, 0, None, int(s2.faces()[2]), 0x8009FFFFFFFFFFF]
    rows = spark.createDataFrame([(x,) for x in ids], "c long").coalesce(1)
    shapes = [r[0] for r in rows.select(grids.to_wkb(F.col("c"), "h3")).collect()]
    assert [s is None for s in shapes] == [False, True, True, True, False] and struct.unpack_from("<BII", shapes[0]) == (1, 3, 1)
    # beside nulls and ids of other grids, each id keeps all its digits
    got = rows.select(*[c.alias(n) for c, n in zip(grids.center(F.col("c"), "h3"), ("lng", "lat"), strict=True)], h3.cell_to_lat(F.col("c")).alias("again")).coalesce(1).first()
    want = [float(np.degrees(v[0])) for v in h3.centres(np.array(ids[:1]))]
    assert (got["lat"], got["lng"]) == (pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-12)) and got["again"] == got["lat"]
    assert wkb.read_rings(bytes(shapes[0]))[0][0][0] == pytest.approx([-121.91508032705622, 37.271355866731895], abs=1e-9)
    assert len(rows.select(grids.to_boundary(F.col("c"), "h3")).first()[0]) == 6
    top = wkb.read_rings(bytes([r[0] for r in rows.select(grids.to_wkb(F.col("c"), "s2")).collect()][3]))[0][0]
    assert top[:, 1].max() == 90 and top[:, 0].min() == -180 and top[:, 0].max() == 180  # closed along the pole


def test_cells_around_poles_and_the_antimeridian():
    for name, level in (("h3", 2), ("s2", 3), ("healpix", 2)):
        own = grids.grid(name)
        ids = np.unique(own.cells(np.array([0.0, 0, 180, 179.99, -179.99, 45]), np.array([90.0, -90, 0, 50, -50, 89.9]), level))
        lon, lat, count = own.outlines(ids)
        clon, clat = own.centers(ids)
        for x, y, n, a, b in zip(lon, lat, count, clon, clat, strict=True):
            rings = wkb.read_rings(wkb.cell_outline(x[:n], y[:n]))
            for poly in rings:
                x0, y0 = poly[0][:, 0], poly[0][:, 1]
                assert np.abs(x0).max() <= 180 + 1e-9 and (x0[:-1] * y0[1:] - x0[1:] * y0[:-1]).sum() > 0
            if abs(b) < 89.99:
                assert wkb.contains(rings, np.array([a]), np.array([b]))[0]


STAR = [(12 * np.cos(t) * (1 if k % 2 else 0.4) - 60, 9 * np.sin(t) * (1 if k % 2 else 0.4) + 20) for k, t in enumerate(np.linspace(0, 2 * np.pi, 10, endpoint=False))]


@pytest.mark.parametrize("name, level", [("h3", 3), ("s2", 6)])
def test_fill_against_dense_points(spark, name, level):
    """Cells that hold a point of the polygon, and those all of whose points it holds."""
    own, data = grids.grid(name), wkb.polygon(STAR)
    rng = np.random.default_rng(6)
    lon, lat = rng.uniform(-75, -45, 400_000), rng.uniform(8, 32, 400_000)
    ids, held = own.cells(lon, lat, level), wkb.contains(wkb.read_rings(data), lon, lat)
    some, place = np.unique(ids, return_inverse=True)
    any_, all_ = set(some[np.bincount(place, held) > 0].tolist()), set(some[np.bincount(place, ~held) == 0].tolist())
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data)), (3, None), (4, bytearray())], "key long, wkb binary").repartition(2)
    got = {m: {r["cell"] for r in polyfill.polygons_to_cells(rows, level, m, grid=name).filter("key = 1").collect()} for m in ("contains_centroid", "contains_boundary", "intersects_boundary", "covers")}
    centres = wkb.contains(wkb.read_rings(data), *own.centers(some))
    assert got["contains_centroid"] == set(some[centres].tolist())
    assert got["contains_boundary"] < got["contains_centroid"] < got["covers"] and got["intersects_boundary"] == got["covers"]
    # sides are straight in degrees here and great circles there, so a few points along them differ
    assert len(any_ - got["covers"]) <= 2 and len(got["covers"] - any_) <= 6
    assert len(got["contains_boundary"] - all_) <= 2 and all_ - got["contains_boundary"] <= got["covers"] and len(all_ - got["contains_boundary"]) <= 6
    for m in got:
        deep = polyfill.polygons_to_cells(rows, level, m, levels=1, grid=name)
        assert {r["cell"] for r in deep.filter("key = 2").collect()} == got[m] and deep.filter("key > 2").count() == 0 and deep.count() == 2 * len(got[m])


@pytest.mark.parametrize("name, level", [("h3", 4), ("s2", 6), ("healpix", 5)])
def test_a_polygon_within_a_cell_and_a_hole(name, level):
    own = grids.grid(name)
    (cell,) = own.cells(np.array([10.0]), np.array([40.0]), level)
    (x,), (y,) = own.centers(np.array([cell]))
    square = lambda r, dx=0.0: [(x + dx - r, y - r), (x + dx + r, y - r), (x + dx + r, y + r), (x + dx - r, y + r)]
    tiny = wkb.polygon(square(0.01, 0.05))
    fill = lambda data, mode: polyfill.polygon_cells(data, level, mode, name).tolist()
    assert fill(tiny, "covers") == [cell] and fill(tiny, "contains_centroid") == [] and fill(tiny, "contains_boundary") == []
    assert fill(tiny, "intersects_boundary") == ([] if name == "h3" else [cell])
    ring = lambda points: struct.pack("<I", 5) + b"".join(struct.pack("<dd", *p) for p in [*points, points[0]])
    holed = struct.pack("<BII", 1, 3, 2) + ring(square(5.0)) + ring(square(0.01))
    whole = wkb.polygon(square(5.0))
    assert cell in fill(whole, "contains_boundary") and cell not in fill(holed, "contains_boundary")
    assert cell not in fill(holed, "contains_centroid") and cell in fill(holed, "covers")


@pytest.mark.parametrize("name, level", [("h3", 2), ("s2", 4), ("healpix", 3)])
def test_polygons_past_the_antimeridian_and_around_a_pole(name, level):
    own = grids.grid(name)
    over = wkb.polygon([(170.0, -10.0), (195.0, -10.0), (195.0, 12.0), (170.0, 12.0)])
    parts = struct.pack("<BII", 1, 6, 2) + wkb.polygon([(170.0, -10.0), (180.0, -10.0), (180.0, 12.0), (170.0, 12.0)]) + wkb.polygon([(-180.0, -10.0), (-165.0, -10.0), (-165.0, 12.0), (-180.0, 12.0)])
    for mode in ("contains_centroid", "covers"):
        assert polyfill.polygon_cells(over, level, mode, name).tolist() == polyfill.polygon_cells(parts, level, mode, name).tolist() != []
    cap = wkb.polygon([(-180.0, 75.0), (180.0, 75.0), (180.0, 90.0), (-180.0, 90.0)])
    got = set(polyfill.polygon_cells(cap, level, "covers", name).tolist())
    lon, lat = np.random.default_rng(7).uniform(-180, 180, 20_000), np.random.default_rng(8).uniform(75.1, 90, 20_000)
    assert set(own.cells(lon, lat, level).tolist()) - got == set()
    with pytest.raises(ValueError):
        polyfill.polygon_cells(cap, level, "near", name)


def test_sql_functions_of_every_grid(spark):
    from cellmosaic.sources import formats

    formats.register_sql(spark)
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(-180, 180, 50), rng.uniform(-80, 80, 50)
    spark.createDataFrame([(float(a), float(b), int(r)) for a, b, r in zip(lon, lat, rng.integers(0, 12, 50), strict=True)] + [(None, 1.0, 3), (0.0, 91.0, 3), (0.0, 0.0, 99), (0.0, 0.0, -1)], "lon double, lat double, r int").createOrReplaceTempView("sql_points")
    for g in grids.GRIDS:
        rows = spark.sql(f"WITH c AS (SELECT *, {g}_lonlat_to_cell(lon, lat, r) AS c FROM sql_points) SELECT *, {g}_is_valid(c) AS ok, {g}_get_resolution(c) AS res, {g}_from_string({g}_to_string(c)) AS again, {g}_lonlat_to_cell({g}_to_lng(c), {g}_to_lat(c), r) AS back, {g}_cell_to_parent(c, r - 1) AS up, {g}_to_wkb(c) AS wkb FROM c").collect()
        own = grids.grid(g)
        for r in rows[:50]:
            assert r["ok"] and r["res"] == r["r"] and r["again"] == r["back"] == r["c"] == own.cells(np.array([r["lon"]]), np.array([r["lat"]]), r["r"])[0] and len(r["wkb"]) > 80
            assert (r["up"] is None) == (r["r"] == 0) and (r["up"] is None or own.levels(np.array([r["up"]]))[0] == r["r"] - 1)
        assert all(r["c"] is None and not r["ok"] and r["res"] == -1 and r["wkb"] is None for r in rows[50:])
        shape = wkb.polygon([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]).hex()
        got = spark.sql(f"SELECT {g}_polygon_to_cells(unhex('{shape}'), 3, 'covers') AS c, {g}_polygon_to_cells(NULL, 3, 'covers') AS n, string_to_{g}('zz') AS z").first()
        assert got["c"] == polyfill.polygon_cells(bytes.fromhex(shape), 3, "covers", g).tolist() and got["n"] is None and got["z"] == 0
    assert spark.sql("SELECT cellmosaic_version()").first()[0]


def test_valid_ids(spark):
    rng = np.random.default_rng(8)
    ids = np.r_[rng.integers(-(1 << 62), 1 << 62, 500) * 2 + 1, rng.integers(0, 1 << 59, 500) | 1 << 59, [0, 1, 3, 4, 15, 16, 64, 255, (1 << 62) - 1, 1 << 62, 4 << 58, (16 << 58) - 1, (1 << 63) - 1], h3.base_cells()]
    for k in range(0, 16, 3):
        ids = np.r_[ids, h3.cells(np.arcsin(rng.uniform(-1, 1, 40)), rng.uniform(-3, 3, 40), k), (4 << 2 * k) + rng.integers(0, 12 << 2 * k, 20)]
    rows = spark.createDataFrame([(int(x),) for x in ids], "c long")
    for g in grids.GRIDS:
        want = [bool(r[0]) for r in rows.select(F.coalesce(grids.grid(g).valid(F.col("c")), F.lit(False))).collect()]
        got = grids.valid_ids(ids, g)
        if g == "healpix":
            want = [any(4 << 2 * d <= x < 16 << 2 * d for d in range(30)) for x in ids.tolist()]
        assert got.tolist() == want, g
