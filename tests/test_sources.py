from __future__ import annotations

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.sources import formats, geotiff, tiles


def gradient(dtype, height=48, width=64):
    r, c = np.mgrid[:height, :width]
    return ((c + 3 * r) % 17 + 1).astype(dtype)


@pytest.mark.parametrize("compression", [geotiff.NONE, geotiff.DEFLATE, geotiff.LZW, geotiff.PACKBITS, geotiff.ZSTD])
def test_codecs_predictors_layouts(tmp_path, compression):
    for dtype, predictor, tile, big in itertools.product(("u1", "i2", "f4", "f8"), (1, 2, 3), (None, 16), (False, True)):
        if (predictor == 3) != (dtype[0] == "f") and predictor != 1:
            continue
        values = gradient(dtype)
        path = str(tmp_path / f"{dtype}{predictor}{tile}{big}.tif")
        open(path, "wb").write(geotiff.write_geotiff(values, (0, 0), (1, 1), compression=compression, predictor=predictor, tile=tile, big=big, rows_per_strip=7))
        info = geotiff.read_info(path)
        out = np.zeros_like(values)
        with geotiff.filesystem(path)[0].open_input_file(path) as f:
            for k in range(info.chunks):
                col, row, w, h = info.box(k)
                out[row : row + h, col : col + w] = geotiff.read_chunk(f, info, k, [1])[:, :, 0]
        assert (out == values).all(), (dtype, predictor, tile)


def test_lzw_long_data():
    data = np.random.default_rng(1).integers(0, 60, 30000).astype(np.uint8).tobytes()
    assert geotiff.unpack_lzw(geotiff.pack_lzw(data)) == data


def read(spark, path, **options):
    formats.register(spark)
    return spark.read.format("raster_pixels").options(**options).load(str(path))


def test_planar_equals_interleaved(spark, tmp_path):
    values = np.stack([gradient("i2") * k for k in range(1, 13)], axis=2)
    for name, planar in (("a", False), ("b", True)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.write_geotiff(values, (0, 0), (1, 1), planar=planar, tile=16))
    one, two = (read(spark, tmp_path / f"{n}.tif", bands="3,1").orderBy("row", "col").collect() for n in "ab")
    assert one == two and one[5]["band_3"] == 3 * one[5]["band_1"]


def test_validity_and_calibration(spark, tmp_path):
    values = np.array([[1, 2, 3], [4, 2, 0]], dtype="i2")
    alpha = np.array([[255, 255, 255], [255, 255, 0]], dtype="i2")
    (tmp_path / "x.tif").write_bytes(geotiff.write_geotiff(np.dstack([values, alpha]), (0, 0), (1, 1), nodata=2, scale={1: (0.5, 10.0)}, alpha=True))
    got = {(r["row"], r["col"]): r["value"] for r in read(spark, tmp_path / "x.tif").collect()}
    assert got == {(0, 0): 10.5, (0, 1): None, (0, 2): 11.5, (1, 0): 12.0, (1, 1): None, (1, 2): None}
    (tmp_path / "bad.tif").write_bytes(geotiff.write_geotiff(values, (0, 0), (1, 1), scale={1: (0.0, 1.0)}))
    with pytest.raises(ValueError):
        geotiff.read_info(str(tmp_path / "bad.tif"))


def test_sparse_chunks_and_pruning(spark, tmp_path):
    (tmp_path / "t.tif").write_bytes(geotiff.write_geotiff(gradient("f4"), (0, 0), (1, 1), tile=16, sparse=frozenset({0})))
    assert read(spark, tmp_path / "t.tif").count() == 48 * 64 - 256
    reader = geotiff.PixelReader({"path": str(tmp_path / "t.tif"), "bbox": "20,-10,30,-1", "target_chunks": "1"})
    assert [(p.first, p.last) for p in reader.partitions()] == [(1, 1)]
    assert read(spark, tmp_path / "t.tif").filter("x >= 20 and x <= 30 and y >= -10").count() == 10 * 10


def test_bbox_clips_pixels_and_wraps(spark, tmp_path):
    (tmp_path / "w.tif").write_bytes(geotiff.write_geotiff(gradient("f4", 18, 36), (-180, 90), (10, 10), tile=16))
    got = {(r["x"], r["y"]) for r in read(spark, tmp_path / "w.tif", bbox="-20,-20,25,15").collect()}
    assert got == {(x, y) for x in (-15.0, -5.0, 5.0, 15.0, 25.0) for y in (-15.0, -5.0, 5.0, 15.0)}
    got = {(r["x"], r["y"]) for r in read(spark, tmp_path / "w.tif", bbox="165,0,-170,10").collect()}
    assert got == {(165.0, 5.0), (175.0, 5.0), (-175.0, 5.0)}
    assert read(spark, tmp_path / "w.tif", bbox="500,0,600,10").count() == 0


@pytest.mark.parametrize("tile, big", [(None, False), (16, True)])
def test_internal_masks(spark, tmp_path, tile, big):
    mask = np.random.default_rng(2).random((48, 61)) < 0.6
    values = gradient("i2", 48, 61)
    (tmp_path / "m.tif").write_bytes(geotiff.write_geotiff(values, (0, 0), (1, 1), tile=tile, big=big, rows_per_strip=7, mask=mask))
    got = {(r["row"], r["col"]): r["value"] for r in read(spark, tmp_path / "m.tif", target_chunks="2").collect()}
    assert got == {(r, c): float(values[r, c]) if mask[r, c] else None for r in range(48) for c in range(61)}


def test_partitions_carry_their_own_chunks(tmp_path):
    (tmp_path / "t.tif").write_bytes(geotiff.write_geotiff(np.dstack([gradient("u1", 256, 256)] * 3), (0, 0), (1, 1), tile=16, planar=True))
    reader = geotiff.PixelReader({"path": str(tmp_path / "t.tif"), "bands": "3,1", "target_chunks": "4"})
    parts = reader.partitions()
    assert len(parts) == 64 and all(len(p.info.offsets) == len(p.info.sizes) == 8 for p in parts)


def test_many_files_are_opened_in_tasks(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.tif").write_bytes(geotiff.write_geotiff(gradient("u1"), (k * 64, 0), (1, 1), tile=16))
    options = {"path": str(tmp_path), "split_bytes": "1000", "bbox": "60,-20,70,-10"}
    eager = geotiff.PixelReader(options)
    rows = lambda r: sorted(tuple(x.values()) for p in r.partitions() for b in r.read(p) for x in b.to_pylist())
    want = rows(eager)
    monkeypatch.setattr(geotiff, "MOST_OPENED", 1)
    lazy = geotiff.PixelReader(options)
    assert all(isinstance(p, geotiff.FileShare) for p in lazy.partitions()) and len(lazy.partitions()) > 3
    assert rows(lazy) == want and len(want) == 100


def test_mosaic_sources(tmp_path):
    for n in "ba":
        (tmp_path / f"{n}.tif").write_bytes(geotiff.write_geotiff(gradient("u1"), (0, 0), (1, 1)))
    (tmp_path / "m.vrt").write_text('<VRTDataset><SourceFilename relativeToVRT="1">b.tif</SourceFilename><SourceFilename relativeToVRT="1">a.tif</SourceFilename></VRTDataset>')
    names = lambda p: [x.rpartition("/")[2] for x in geotiff.resolve(p)]
    assert names(f"{tmp_path}/*.tif") == ["a.tif", "b.tif"] == names(str(tmp_path))
    assert names(f"{tmp_path}/b.tif,{tmp_path}/a.tif") == ["b.tif", "a.tif"] == names(f"{tmp_path}/m.vrt")


def test_tiles_and_archive(spark, tmp_path):
    cells = spark.range(64, 256).select(F.col("id").alias("cell"), (F.col("id") / 7).alias("mean"), F.lit(None).cast("double").alias("gone"))
    encoded = tiles.encoded_tiles(cells, 2, 3, ["mean", "gone"])
    path = str(tmp_path / "x.pmtiles")
    n = tiles.write_pmtiles(encoded, path)
    found = tiles.read_pmtiles(open(path, "rb").read())
    assert n == len(found) == encoded.count() and struct.unpack_from("<B", open(path, "rb").read(), 7)[0] == 3
    features = [f for data in found.values() for f in tiles.decode_tile(data)]
    assert {f[0] for f in features} == set(range(64, 256))
    assert all(f[2] == {"mean": f[0] / 7} and len(f[1]) == 4 for f in features)


def test_wide_cells_cover_all_their_tiles(spark):
    cells = spark.createDataFrame([(4,), (15,)], "cell long")
    got = tiles.tile_cover(cells, 0, 9).groupBy("cell").count().collect()
    assert all(r["count"] > 10_000 for r in got) and len(got) == 2
    assert tiles.tile_cover(cells, 0, 2).distinct().count() == tiles.tile_cover(cells, 0, 2).count()


def test_tile_ids():
    assert [tiles.tile_id(0, 0, 0), tiles.tile_id(1, 0, 0), tiles.tile_id(1, 0, 1), tiles.tile_id(1, 1, 1), tiles.tile_id(1, 1, 0), tiles.tile_id(2, 0, 0)] == [0, 1, 2, 3, 4, 5]
    assert sorted(tiles.tile_id(4, x, y) for x in range(16) for y in range(16)) == list(range(85, 341))


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), bytearray(b"\x01\xff"))], "b long, a double, wkb binary")
    tiles.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1,"wkb":"01ff"}'


def test_scan_from_a_path_and_options(spark, tmp_path):
    from cellmosaic.plans.options import ScanOptions
    from cellmosaic.sources import scan

    values = np.where(np.arange(40 * 60).reshape(40, 60) % 7 == 0, -1.0, np.arange(40 * 60).reshape(40, 60) % 50)
    (tmp_path / "a.tif").write_bytes(geotiff.write_geotiff(values, (10, 50), (0.05, 0.05), tile=16, nodata=-1.0))
    rows = lambda **o: {(r["resolution"], r["cell"]): r for r in scan.scan_cells(spark, str(tmp_path / "a.tif"), ScanOptions(**o)).collect()}
    for grid, low, high in (("healpix", 6, 8), ("s2", 6, 8), ("h3", 4, 5)):
        got = rows(grid=grid, resolutions=(low, high), quantiles="p50")
        for r in (low, high):
            assert sum(x["count"] for (k, _), x in got.items() if k == r) == (values >= 0).sum() and sum(x["sum"] for (k, _), x in got.items() if k == r) == pytest.approx(values[values >= 0].sum())
        assert all(x["min"] - 1 <= x["p50"] <= x["max"] + 1 for x in got.values())
        few = rows(grid=grid, resolutions=(high,), min_count=20, max_mean=24)
        assert set(few) == {k for k, x in got.items() if k[0] == high and x["count"] >= 20 and x["mean"] <= 24}
    every = rows(grid="healpix", resolutions=(12,), nodata_policy="emit", emit_nodata_value=-5.0)
    assert {x["mean"] for x in every.values() if x["count"] == 0} == {-5.0}
    classes = scan.scan_classes(spark, str(tmp_path / "a.tif"), ScanOptions(grid="h3", resolutions=(4,), remap="0..24: 1, else -> 2")).collect()
    assert sum(r["total_count"] for r in classes) == (values >= 0).sum() and all(r["majority_class"] in (1, 2) for r in classes)
    with pytest.raises(ValueError, match="a5"):
        rows(grid="a5", resolutions=(4,))
    plan = scan.scan_cells(spark, str(tmp_path / "a.tif"), ScanOptions(grid="healpix", resolutions=(6,))).filter("cell = 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")  # below the aggregation


def test_scan_of_a_projected_raster(spark, tmp_path):
    from cellmosaic.functions import crs
    from cellmosaic.plans.options import ScanOptions
    from cellmosaic.sources import scan

    (tmp_path / "l.tif").write_bytes(geotiff.write_geotiff(gradient("f4"), (4_000_000, 3_000_000), (1000, 1000), epsg=3035))
    got = scan.samples(spark, str(tmp_path / "l.tif"), ScanOptions(grid="h3")).collect()
    want = crs.with_lonlat(spark.createDataFrame([(4_000_500.0, 2_999_500.0)], "x double, y double"), 3035).first()
    assert len(got) == 48 * 64
    first = next(r for r in got if (r["col"], r["row"]) == (0, 0))
    assert (first["lon"], first["lat"]) == (pytest.approx(want["lon"]), pytest.approx(want["lat"]))
