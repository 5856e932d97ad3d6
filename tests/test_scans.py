"""Scan options one by one, the number of reads, and the cells source."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cellmosaic.functions import grids
from cellmosaic.operators import continuous
from cellmosaic.plans.options import ScanOptions, parse_bands
from cellmosaic.sources import cells, geotiff, scan

VALUES = np.where(np.arange(40 * 60).reshape(40, 60) % 7 == 0, -1.0, np.arange(40 * 60).reshape(40, 60) % 50)


@pytest.fixture(scope="module")
def raster(tmp_path_factory):
    path = tmp_path_factory.mktemp("raster") / "a.tif"
    path.write_bytes(geotiff.write_geotiff(np.dstack([VALUES, VALUES * 2 + 1]), (10, 50), (0.05, 0.05), tile=16, nodata=-1.0))
    return str(path)


def rows(spark, path, **options):
    found = scan.scan_cells(spark, path, ScanOptions(**{"grid": "healpix", "resolutions": (7,)} | options))
    return {tuple(r[k] for k in ("resolution", "band", "cell") if k in found.columns): r.asDict() for r in found.collect()}


def test_one_read_for_all_levels(spark, raster):
    """Levels, quantiles and empty cells come from one read of the files."""
    reads = []
    run = geotiff.PixelReader.partitions
    try:
        geotiff.PixelReader.partitions = lambda self: reads.append(1) or run(self)
        for options in ({"resolutions": (4, 6, 8)}, {"resolutions": (5, 7), "quantiles": "p50"}, {"resolutions": (5, 7), "quantiles": "p50", "nodata_policy": "emit"}, {"grid": "h3", "resolutions": (3, 4, 5)}):
            found = scan.scan_cells(spark, raster, ScanOptions(**{"grid": "healpix"} | options))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("BatchScan raster_pixels") <= 1
            assert found.count() > 0
    finally:
        geotiff.PixelReader.partitions = run


@pytest.mark.parametrize("grid, levels", [("healpix", (2, 5, 9)), ("s2", (3, 8)), ("h3", (2, 4))])
def test_levels_agree_with_levels_alone(spark, raster, grid, levels):
    every = rows(spark, raster, grid=grid, resolutions=levels, quantiles="p25,p75", nodata_policy="emit")
    for r in levels:
        one = rows(spark, raster, grid=grid, resolutions=(r,), quantiles="p25,p75", nodata_policy="emit")
        assert one.keys() == {k for k in every if k[0] == r}
        for k, x in one.items():
            assert all(every[k][c] == pytest.approx(v, rel=1e-9) if v is not None else every[k][c] is None for c, v in x.items())


def test_bands_and_formulas(spark, raster):
    each = rows(spark, raster, bands="1,2")
    alone = {b: rows(spark, raster, band=b) for b in (1, 2)}
    assert {k[1] for k in each} == {1, 2}
    for (r, b, c), x in each.items():
        assert x["sum"] == pytest.approx(alone[b][r, c]["sum"]) and x["count"] == alone[b][r, c]["count"]
    index = rows(spark, raster, bands="nir=2,red=1", formula="ndvi")
    good = VALUES >= 0
    want = ((VALUES * 2 + 1) - VALUES)[good] / ((VALUES * 2 + 1) + VALUES)[good]
    assert sum(x["sum"] for x in index.values()) == pytest.approx(want.sum()) and sum(x["count"] for x in index.values()) == good.sum()
    assert parse_bands("NIR=4, red=3") == {"nir": 4, "red": 3} and parse_bands("2,1") == {"2": 2, "1": 1}
    for bad in ({"bands": "0"}, {"formula": "ndvi"}, {"formula": "ndvi", "bands": "1,2"}, {"partition": "2/2"}, {"partition": "x"}):
        with pytest.raises(ValueError):
            ScanOptions(**bad)


def test_partitions_add_up(spark, raster):
    parts = [scan.scan_cells(spark, raster, ScanOptions(grid="healpix", resolutions=(6, 8), partition=f"{k}/3")) for k in range(3)]
    assert all(set(continuous.STATE) <= set(p.columns) for p in parts)
    merged = continuous.finished(continuous.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["resolution", "cell"]))
    whole = rows(spark, raster, resolutions=(6, 8))
    got = {(r["resolution"], r["cell"]): r for r in merged.collect()}
    assert got.keys() == whole.keys() and all(got[k][c] == pytest.approx(whole[k][c]) for k in got for c in ("count", "sum", "mean", "stddev", "min", "max"))


def test_transfers(spark, raster):
    at = rows(spark, raster, resolutions=(8,), transfer="interpolate", interpolation="nearest")
    own = grids.grid("healpix")
    for (_, c), x in at.items():
        (lon,), (lat,) = own.centers(np.array([c]))
        assert VALUES[int((50 - lat) / 0.05), int((lon - 10) / 0.05)] == x["mean"]
    for grid, level in (("healpix", 7), ("s2", 8), ("h3", 4)):
        mass = rows(spark, raster, grid=grid, resolutions=(level,), transfer="overlay", mass_preserve=True)
        assert sum(x["sum"] for x in mass.values()) == pytest.approx(VALUES[VALUES >= 0].sum(), rel=1e-6)
        full = rows(spark, raster, grid=grid, resolutions=(level,), transfer="overlay", valid_coverage_threshold=0.85)
        assert 0 < len(full) < len(rows(spark, raster, grid=grid, resolutions=(level,), transfer="overlay"))
        ones = rows(spark, raster, grid=grid, resolutions=(level,), transfer="overlay", overlay_weighted=False)
        assert all(x["count"] == round(x["count"]) for x in ones.values())


def test_options_without_use_are_refused(spark, raster):
    for bad in ({"remap": "1: 2"}, {"histogram": "2:0:1"}, {"min_majority_fraction": 0.5}, {"extra": {"x": 1}}, {"mass_preserve": True}, {"interpolation": "bicubic"}, {"valid_coverage_threshold": 0.5}, {"partition": "0/2", "min_count": 1.0}, {"partition": "0/2", "quantiles": "p50"}):
        with pytest.raises(ValueError):
            scan.scan_cells(spark, raster, ScanOptions(grid="healpix", resolutions=(5,), **bad))
    for bad in ({"compact": True}, {"quantiles": "p50"}, {"min_mean": 1.0}, {"nodata_policy": "emit"}, {"transfer": "overlay"}, {"histogram": "2:0:50", "min_majority_fraction": 0.5}, {"partition": "0/2"}):
        with pytest.raises(ValueError):
            scan.scan_classes(spark, raster, ScanOptions(grid="healpix", resolutions=(5,), **bad))


def test_class_options(spark, raster):
    classes = lambda **o: {(r["resolution"], r["cell"]): r for r in scan.scan_classes(spark, raster, ScanOptions(**{"grid": "healpix", "resolutions": (5, 7)} | o)).collect()}
    every = classes()
    assert {k for k, r in every.items() if r["total_count"] >= 30} == set(classes(min_count=30.0))
    assert set(classes(min_majority_fraction=0.05)) == {k for k, r in every.items() if r["majority_fraction"] >= 0.05}
    assert all(round(r["shannon_entropy"], 2) == r["shannon_entropy"] for r in classes(decimals=2).values())
    alone = classes(resolutions=(5,))
    assert all(every[k]["histogram"] == r["histogram"] for k, r in alone.items())
    bins = scan.scan_classes(spark, raster, ScanOptions(grid="healpix", resolutions=(5,), histogram="5:0:50")).groupBy("resolution").agg(F.sum("weight")).first()
    assert bins[1] == (VALUES >= 0).sum()


def test_failed_transforms_are_counted(spark, tmp_path):
    (tmp_path / "l.tif").write_bytes(geotiff.write_geotiff(np.ones((4, 6), "f4"), (14_000_000, 3_000_000), (1_000_000, 1_000_000), epsg=3035))
    seen = Observation()
    at = scan.samples(spark, str(tmp_path / "l.tif"), ScanOptions(grid="h3"), failures=seen)
    left = at.count()
    assert left < 24 and seen.get["failed"] == 24 - left
    with pytest.raises(PySparkException, match="EPSG:3035"):
        scan.samples(spark, str(tmp_path / "l.tif"), ScanOptions(grid="h3", strict_transforms=True)).collect()


# --- the cells source ------------------------------------------------------------------------------------------------


def source(spark, path, **options):
    cells.register(spark)
    return spark.read.format("cells").options(**{"grid": "healpix", "resolutions": "6-8", "target_chunks": "4"} | options).load(path)


@pytest.mark.parametrize("grid, levels", [("healpix", "6-8"), ("s2", "7,9"), ("h3", "3,5")])
def test_whole_and_partial_cells(spark, raster, grid, levels):
    found = source(spark, raster, grid=grid, resolutions=levels)
    kinds = {r[0]: r[1] for r in found.groupBy(F.isnull("partial_state")).count().collect()}
    assert kinds[True] > 0 and kinds[False] > 0
    assert found.filter("partial_state IS NULL").groupBy("resolution", "cell").count().filter("count > 1").isEmpty()
    alone = found.filter("partial_state IS NULL").select("resolution", "cell").intersect(found.filter("partial_state IS NOT NULL").select("resolution", "cell"))
    assert alone.isEmpty()
    got = {(r["resolution"], r["cell"]): r for r in cells.finished(found).collect()}
    want = rows(spark, raster, grid=grid, resolutions=tuple(sorted({r for r, _ in got})))
    assert got.keys() == want.keys() and all(got[k][c] == pytest.approx(want[k][c], abs=1e-9) for k in got for c in ("count", "sum", "mean", "stddev", "min", "max"))


def chunks(reader):
    return sum(run.last - run.first + 1 for p in reader.partitions() for run in p.runs)


def test_filters_leave_chunks_out(spark, raster):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNull, LessThanOrEqual

    def reader(*filters, **options):
        made = cells.CellReader({"path": raster, "grid": "healpix", "resolutions": "8,9"} | options)
        left = list(made.pushFilters(list(filters)))
        return made, left

    every, _ = reader()
    assert chunks(every) == 12
    whole = sorted(c for r, c in rows(spark, raster, resolutions=(9,)) if r == 9)
    one, left = reader(EqualTo(("cell",), whole[3]))
    assert 0 < chunks(one) <= 4 and left  # Spark tests rows again
    some, _ = reader(GreaterThanOrEqual(("cell",), whole[10]), LessThanOrEqual(("cell",), whole[16]))
    assert 0 < chunks(some) < 12
    none, left = reader(In(("resolution",), (3, 4)))
    assert chunks(none) == 0 and left
    final, left = reader(IsNull(("partial_state",)))
    assert left and final.rows == {"final"}
    other, _ = reader(EqualTo(("cell",), 5))  # no cell of these resolutions
    assert chunks(other) == 0
    far, _ = reader(bbox="40,40,41,41")
    assert chunks(far) == 0
    for grid, level in (("h3", 5), ("s2", 9)):
        (cell,) = grids.grid(grid).cells(np.array([10.3]), np.array([49.7]), level)
        made, _ = reader(EqualTo(("cell",), int(cell)), grid=grid, resolutions=str(level))
        assert 0 < chunks(made) < 12


@pytest.mark.parametrize("condition", ["resolution = 7", "resolution IN (6, 8) AND count >= 20", "cell BETWEEN {low} AND {high}", "cell = {low}", "cell > {low} AND resolution >= 7", "partial_state IS NULL AND mean > 20", "resolution = 12", "partial_state IS NULL AND count >= 30", "cell IN ({low}, {high}, 7) OR count > 40"])
def test_pushed_filters_keep_the_rows(spark, raster, condition):
    ids = sorted(r["cell"] for r in source(spark, raster, resolutions="8").select("cell").distinct().collect())
    condition = condition.format(low=ids[len(ids) // 3], high=ids[len(ids) // 2])
    found = sorted(map(str, source(spark, raster).filter(condition).collect()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        every = spark.createDataFrame(source_rows(raster), cells.SCHEMA)
        assert found == sorted(map(str, every.filter(condition).collect()))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert found or "12" in condition


def source_rows(path):
    reader = cells.CellReader({"path": path, "grid": "healpix", "resolutions": "6-8", "target_chunks": "4"})
    return [tuple(bytearray(v) if isinstance(v, bytes) else v for v in r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("grid, level", [("healpix", 4), ("s2", 4), ("s2", 1)])
def test_ranges_of_ids_as_few_cells(grid, level):
    own = grids.grid(grid)
    ids = own.roots()
    for _ in range(level):
        ids = own.children(ids)
    ids = np.sort(ids)
    rng = np.random.default_rng(9)
    for _ in range(40):
        low, high = sorted(rng.choice(ids, 2).tolist())
        low, high = low - int(rng.integers(0, 2)), high + int(rng.integers(0, 2))
        few = cells.cells_of_range(grid, level, low, high)
        below = few
        while len(below) and (own.levels(below) < level).any():
            deep = own.levels(below) == level
            below = np.r_[below[deep], own.children(below[~deep])]
        assert sorted(below.tolist()) == ids[(ids >= low) & (ids <= high)].tolist() and len(few) <= 12 * level + 12


def test_histogram_options(spark, raster):
    run = lambda **o: scan.scan_classes(spark, raster, ScanOptions(**{"grid": "healpix", "resolutions": (5,), "histogram": "5:0:50"} | o))
    cells_ = {r["cell"]: r[1] for r in run(histogram_weight="area", histogram_normalize="fraction").groupBy("cell").agg(F.sum("weight")).collect()}
    assert cells_ and all(v == pytest.approx(1) for v in cells_.values())
    areas = run(histogram_weight="area").groupBy().agg(F.sum("weight")).first()[0]
    assert areas == pytest.approx((VALUES >= 0).sum(), rel=1e-6)
    text = run(histogram_json=True).first()["histogram"]
    assert text.startswith("[[0,10,") and text.count("[") == 6
    values = {r["category"]: r["weight"] for r in run(histogram="values").groupBy("category").agg(F.sum("weight").alias("weight")).collect()}
    assert values == {v: float((VALUES == v).sum()) for v in np.unique(VALUES) if v >= 0}
    assert run(histogram="values", histogram_json=True).first()["histogram"].startswith('{"0":')
    for bad in ({"histogram_weight": "mass"}, {"histogram": None, "histogram_weight": "area"}, {"histogram": "values", "histogram_normalize": "density"}, {"histogram_weight": "area", "overlay_weighted": False, "transfer": "overlay"}, {"histogram_weight": "area", "transfer": "interpolate"}):
        with pytest.raises(ValueError):
            run(**bad)


@pytest.mark.parametrize("code, origin, pixel", [(4326, (-179.0, 60.0), 1.0), (3857, (-2.0e7, 9.0e6), 100_000.0)])
def test_points_within_a_geometry(spark, tmp_path, code, origin, pixel):
    """An envelope over the antimeridian leaves chunks out; the geometry itself tells points."""
    import struct

    from cellmosaic.functions import wkb

    (tmp_path / "w.tif").write_bytes(geotiff.write_geotiff(np.arange(128 * 358, dtype="f4").reshape(128, 358), origin, (pixel, pixel), tile=16, epsg=code))
    shape = wkb.polygon([(165.0, 10.0), (190.0, 5.0), (200.0, 40.0), (172.0, 30.0)])
    holed = struct.pack("<BII", 1, 6, 2) + wkb.polygon([(10.0, 10.0), (20.0, 10.0), (15.0, 25.0)]) + wkb.polygon([(12.0, 11.0), (16.0, 11.0), (14.0, 15.0)])
    every = scan.samples(spark, str(tmp_path / "w.tif"), ScanOptions(grid="healpix")).collect()
    for data in (shape, holed):
        rings = wkb.read_rings(data)
        inside = lambda r, rings=rings: any(wkb.contains(rings, np.array([r["lon"] + t]), np.array([r["lat"]]))[0] for t in (-360, 0, 360))
        want = {(r["col"], r["row"]) for r in every if r["lat"] > 0 and inside(r)}
        got = scan.samples(spark, str(tmp_path / "w.tif"), ScanOptions(grid="healpix", within=data)).collect()
        assert {(r["col"], r["row"]) for r in got} == want and want
        reader = geotiff.PixelReader({"path": str(tmp_path / "w.tif"), "lonlat_bbox": ",".join(map(repr, wkb.envelope(data))), "target_chunks": "1"})
        assert sum(p.last - p.first + 1 for p in reader.partitions()) < 40
        both = scan.samples(spark, str(tmp_path / "w.tif"), ScanOptions(grid="healpix", within=data, bbox=(160.0, 0.0, -155.0, 90.0))).count()
        assert (both == len(want)) == (data is shape) and (both == 0) == (data is holed)
    assert wkb.envelope(shape) == (165.0, 5.0, -160.0, 40.0) and wkb.envelope(struct.pack("<BII", 1, 6, 0)) is None
    assert scan.samples(spark, str(tmp_path / "w.tif"), ScanOptions(grid="healpix", within=struct.pack("<BII", 1, 6, 0))).count() == 0


def test_automatic_resolutions(spark, tmp_path):
    from cellmosaic.plans.options import parse_auto

    assert [parse_auto(t) for t in ("auto", " AUTO ", "auto+1", "Auto - 2", "auto+64", "7")] == [0, 0, 1, -2, 64, None]
    for bad in ("auto+", "auto1", "auto+1.5", "auto+-1", "auto+65", "automatic", "auto+x"):
        with pytest.raises(ValueError, match="auto"):
            parse_auto(bad)
    (tmp_path / "d.tif").write_bytes(geotiff.write_geotiff(np.ones((20, 20), "f4"), (10, 50), (0.05, 0.05)))
    (tmp_path / "u.tif").write_bytes(geotiff.write_geotiff(np.ones((20, 20), "f4"), (500_000, 5_540_000), (30, 30), epsg=32632))
    for grid, wide, fine in (("h3", 6, 11), ("s2", 11, 18), ("healpix", 11, 18)):
        got = [scan.auto_resolution(spark, str(tmp_path / f), grid) for f in ("d.tif", "u.tif")]
        areas = [3.5e3 * 5.55e3, 900.0]
        assert got == [grids.matched_resolution(grid, a) for a in areas] and abs(got[0] - wide) <= 1 and abs(got[1] - fine) <= 1
    assert scan.auto_resolution(spark, str(tmp_path / "d.tif"), "h3", 64) == 15 and scan.auto_resolution(spark, str(tmp_path / "d.tif"), "h3", -64) == 0
    found = scan.scan_cells(spark, str(tmp_path / "d.tif"), ScanOptions(grid="healpix", resolutions="auto-1"))
    assert {r["resolution"] for r in found.collect()} == {scan.auto_resolution(spark, str(tmp_path / "d.tif"), "healpix") - 1}
    assert ScanOptions(resolutions="3-5").resolutions == (3, 4, 5)


def test_geoparquet_footers(spark, tmp_path):
    import json

    from pyarrow import parquet

    from cellmosaic.sources import tiles

    every = np.arange(4 << 8, 16 << 8)
    x, y = grids.grid("healpix").planar(every)
    over = every[(np.abs(x).max(axis=1) > 181) & (np.abs(y) < 30).all(axis=1)]
    ids = np.r_[over[:1], grids.grid("healpix").cells(np.array([0.1, 20.0]), np.array([10.0, 60.0]), 4)]
    tiles.write_geoparquet(tiles.with_outline(spark.createDataFrame([(int(c),) for c in ids], "cell long"), 4), str(tmp_path / "g"), 1).count()
    (file,) = (tmp_path / "g").glob("*.parquet")
    geo = json.loads(parquet.read_metadata(file).metadata[b"geo"])["columns"]["wkb"]
    west, south, east, north = geo["bbox"]
    assert (west, east) == (-180, 180) and -30 < south < 30 and 60 < north < 66 and geo["crs"]["id"]["code"] == "CRS84" and set(geo["geometry_types"]) == {"Polygon", "MultiPolygon"}
