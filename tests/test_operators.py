from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import categorical, continuous, mosaic, pixels, polyfill, quantiles, transfer
from cellmosaic.functions import wkb
from cellmosaic.plans.options import ScanOptions, parse_bbox, parse_edges, parse_quantiles, parse_resolutions


def samples(spark, rows):
    return spark.createDataFrame(rows, "cell long, value double, weight double")


def test_statistics(spark):
    rows = [(1, 100.0, 0.4), (1, 200.0, 0.6), (2, 5.0, 1.0), (3, float("nan"), 1.0), (3, 4.0, 0.0), (4, None, 1.0)]
    got = {r["cell"]: r for r in continuous.weighted_statistics(samples(spark, rows), ["cell"]).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["count"], got[1]["sum"], got[1]["mean"]) == (pytest.approx(1), pytest.approx(160), pytest.approx(160))
    assert got[2]["stddev"] == 0.0


def test_merging_equals_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), float(v), float(w)) for c, v, w in zip(rng.integers(0, 4, 400), rng.normal(50, 9, 400), rng.uniform(0.1, 1, 400), strict=True)]
    s = samples(spark, rows).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(5)))
    whole = {r["cell"]: r for r in continuous.weighted_statistics(s, ["cell"]).collect()}
    parts = {r["cell"]: r for r in continuous.finished(continuous.merge_states(continuous.partial_states(s, ["cell", "part"]), ["cell"])).collect()}
    for c in whole:
        assert all(parts[c][k] == pytest.approx(whole[c][k], rel=1e-9) for k in ("count", "sum", "mean", "stddev", "min", "max"))


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.25, 0.75)])
def test_deviation_far_from_zero(spark, weights):
    """Weighted, merged, compacted and streamed forms of values that hardly differ beside their mean."""
    rng = np.random.default_rng(5)
    values, w = 1e9 + rng.integers(0, 2, 1000), rng.choice(weights, 1000)
    mean = np.average(values - 1e9, weights=w)
    want = np.sqrt((w * (values - 1e9 - mean) ** 2).sum() / (w.sum() - (w**2).sum() / w.sum()))
    s = samples(spark, [(k % 4, float(v), float(x)) for k, (v, x) in enumerate(zip(values, w, strict=True))])
    whole = s.withColumn("cell", F.lit(0))
    assert continuous.weighted_statistics(whole, ["cell"]).first()["stddev"] == pytest.approx(want, rel=1e-6)
    parts = continuous.partial_states(whole.withColumn("part", F.pmod(F.xxhash64("value", "weight", F.monotonically_increasing_id()), F.lit(7))), ["cell", "part"])
    assert continuous.finished(continuous.merge_states(parts, ["cell"])).first()["stddev"] == pytest.approx(want, rel=1e-6)
    four = continuous.partial_states(s, ["cell"]).withColumn("resolution", F.lit(3))
    up = continuous.finished(continuous.compacted(four, F.lit(9).cast("long"))).collect()
    assert len(up) == 1 and up[0]["stddev"] == pytest.approx(want, rel=1e-6)
    if weights == (1.0, 1.0):
        unit = continuous.finished(continuous.partial_states(whole, ["cell"], weight=None)).first()
        assert unit["stddev"] == pytest.approx(continuous.unit_statistics(whole, ["cell"]).first()["stddev"], rel=1e-6)


def test_rounding(spark):
    got = spark.createDataFrame([(1.23456,), (2.5,), (-2.5,), (1.005,), (6e15,)], "v double").select(continuous.rounded(F.col("v"), 2), continuous.rounded(F.col("v"), 0)).collect()
    assert [r[0] for r in got] == [1.23, 2.5, -2.5, 1.0, 6e15]
    assert [r[1] for r in got] == [1.0, 3.0, -3.0, 1.0, 6e15]


def test_classes(spark):
    rows = [(1, 10)] * 70 + [(1, 20)] * 30 + [(2, 7), (2, 3)]
    s = spark.createDataFrame(rows, "cell long, cls long")
    got = {r["cell"]: r for r in categorical.summary(categorical.class_weights(s, ["cell"]), ["cell"]).collect()}
    assert (got[1]["majority_class"], got[1]["majority_fraction"], got[1]["histogram"]) == (10, 0.7, '{"10": 0.7000, "20": 0.3000}')
    assert got[2]["majority_class"] == 3 and got[2]["shannon_entropy"] == pytest.approx(np.log(2))


def test_remap(spark):
    s = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "c long")
    run = lambda spec: [r[0] for r in s.select(categorical.remapped(F.col("c"), spec)).collect()]
    assert run("1..3: 10, 2 => 20, else -> 99") == [10, 20, 10, 99, 99]
    assert run("[1, 4]: 7; 9: nodata") == [7, 2, 3, 7, None]
    with pytest.raises(ValueError):
        categorical.parse_remap("10=5")


def test_bins(spark):
    edges = parse_edges("4:0:8")
    values = [-0.1, 0.0, 1.99, 2.0, 7.9, 8.0, 8.1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(categorical.bin_of(F.col("v"), edges)).collect()
    assert [r[0] for r in got] == [None, 0, 0, 1, 3, 3, None]


def test_quantiles_are_close(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.lognormal(3, 1, 3000), -rng.lognormal(2, 1, 1000), np.zeros(100)])
    s = spark.createDataFrame([(1, float(x)) for x in v] + [(2, 4.0)], "cell long, value double")
    targets = parse_quantiles("p05,median,p90,iqr")
    got = {r["cell"]: r for r in quantiles.quantiles(quantiles.buckets(s, ["cell"]), ["cell"], targets).collect()}
    for name, q in targets[:3]:
        assert got[1][name] == pytest.approx(np.quantile(v, q), rel=0.03, abs=0.05)
    assert got[2]["p50"] == 4.0 and got[2]["iqr"] == 0.0


def test_bbox_over_the_antimeridian(spark):
    s = spark.createDataFrame([(179.0, 0.0), (-179.0, 0.0), (0.0, 0.0), (179.0, 9.0)], "lon double, lat double")
    assert s.filter(pixels.in_bbox(F.col("lon"), F.col("lat"), (170.0, -5.0, -170.0, 5.0))).count() == 2


def test_overlap_rules(spark):
    tiles = [dict(west=0, south=0, east=10, north=10), dict(west=6, south=0, east=16, north=10)]
    rows = [(t, x, 5.0) for t, lo, hi in ((0, 0, 10), (1, 6, 16)) for x in np.arange(lo + 0.5, hi)]
    s = spark.createDataFrame([(int(t), float(x), y) for t, x, y in rows], "tile int, lon double, lat double")
    kept = lambda rule: {(r["tile"], r["lon"]) for r in mosaic.owned(s, tiles, rule).collect()}
    assert len(kept("average")) == 20
    assert kept("first") == {(0, x) for x in np.arange(0.5, 10)} | {(1, x) for x in np.arange(10.5, 16)}
    assert kept("cutline") == {(0, x) for x in np.arange(0.5, 8)} | {(1, x) for x in np.arange(8.5, 16)}


@pytest.mark.parametrize("rule", ["first", "cutline"])
def test_many_tiles_own_as_few_do(spark, rule, monkeypatch):
    rng = np.random.default_rng(4)
    tiles = [dict(west=x, south=y, east=x + w, north=y + h) for x, y, w, h in zip(rng.uniform(-20, 20, 30), rng.uniform(-20, 20, 30), rng.uniform(1, 9, 30), rng.uniform(1, 9, 30), strict=True)]
    s = spark.createDataFrame([(int(rng.integers(30)), float(x), float(y)) for x, y in rng.uniform(-25, 30, (4000, 2))], "tile int, lon double, lat double")
    kept = sorted(map(tuple, mosaic.owned(s, tiles, rule).collect()))
    monkeypatch.setattr(mosaic, "FEW_TILES", 100)
    assert kept == sorted(map(tuple, mosaic.owned(s, tiles, rule).collect())) and kept


def test_interpolation_reproduces_a_plane(spark):
    px = spark.createDataFrame([(c, r, 3.0 * c - 2.0 * r) for c in range(12) for r in range(10)], "col long, row long, value double")
    centres = spark.createDataFrame([(1, 4.3, 5.2), (2, 6.9, 3.7)], "cell long, lon double, lat double")
    for kind in ("bilinear", "bicubic"):
        got = {r["cell"]: r["value"] for r in transfer.interpolated(centres, px, 12, 10, (0.0, 10.0), (1.0, 1.0), kind).collect()}
        assert got[1] == pytest.approx(3 * 3.8 - 2 * 4.3) and got[2] == pytest.approx(3 * 6.4 - 2 * 5.8)


def test_polygon_areas_against_sampling():
    rng = np.random.default_rng(7)
    for _ in range(20):
        angle = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 8)))
        x, y = 5 + rng.uniform(1, 4) * np.cos(angle), 4 + rng.uniform(1, 3) * np.sin(angle)
        if rng.random() < 0.5:
            x, y = x[::-1], y[::-1]
        area = transfer.pixel_areas(x, y, np.arange(0, 11), np.arange(0, 9))
        assert area.sum() == pytest.approx(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)
        gx, gy = np.meshgrid((np.arange(11 * 40) + 0.5) / 40, (np.arange(9 * 40) + 0.5) / 40)
        inside = wkb.contains([[np.c_[np.r_[x, x[0]], np.r_[y, y[0]]]]], gx.ravel(), gy.ravel()).reshape(gx.shape)
        assert np.abs(inside.reshape(9, 40, 11, 40).mean(axis=(1, 3)) - area).max() < 0.05


def test_mass_is_preserved(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.5, 3.0), (2, 2.5, 0.0, 4.0, 3.0)], "cell long, west double, south double, east double, north double")
    w = transfer.overlay_weights(transfer.rectangle_overlaps(boxes, 4, 3, (0.0, 3.0), (1.0, 1.0)), mass_preserve=True)
    assert all(r["t"] == pytest.approx(1) for r in w.groupBy("col", "row").agg(F.sum("weight").alias("t")).collect())


def test_polyfill_against_fine_cells(spark):
    """Modes against the centres of cells 16 times as fine: what any of them holds, and what all do."""
    from cellmosaic.functions import healpix

    star = [(12 * np.cos(t) * (1 if k % 2 else 0.4) - 60, 9 * np.sin(t) * (1 if k % 2 else 0.4) + 20) for k, t in enumerate(np.linspace(0, 2 * np.pi, 10, endpoint=False))]
    fine = np.arange(4 << 18, 16 << 18, dtype=np.int64)
    lon, lat = healpix.centers(fine, 9)
    near = (np.abs(lon + 60) < 16) & (np.abs(lat - 20) < 13)
    fine, held = fine[near], wkb.contains(wkb.read_rings(wkb.polygon(star)), lon[near], lat[near])
    up = fine >> 8
    some, counts = np.unique(up[held], return_counts=True)
    whole = set(some[counts == 256].tolist())
    data = spark.createDataFrame([(1, bytearray(wkb.polygon(star)))], "key long, wkb binary")
    got = {m: {r["cell"] for r in polyfill.polygons_to_cells(data, 5, m).collect()} for m in ("centroid", "covers", "contains_boundary")}
    assert got["covers"] >= set(some.tolist()) and got["contains_boundary"] <= whole and whole - got["contains_boundary"] <= got["covers"]
    assert len(got["covers"] - set(some.tolist())) <= 3 and len(whole - got["contains_boundary"]) <= 3
    for m in got:
        deep = polyfill.polygons_to_cells(data, 5, m, levels=1)
        assert {r["cell"] for r in deep.collect()} == got[m] and deep.count() == len(got[m])


def test_polyfill_modes_nest(spark):
    shape = wkb.polygon([(-10.0, -8.0), (14.0, -8.0), (14.0, 11.0), (-10.0, 11.0)])
    inside, centre, covers = (set(polyfill.polygon_cells(shape, 4, m).tolist()) for m in ("contains_boundary", "contains-centroid", "covers"))
    assert inside < centre < covers
    with pytest.raises(ValueError):
        polyfill.polygon_cells(shape, 4, "near")


def test_options():
    assert parse_resolutions("6-8,3") == [3, 6, 7, 8] and parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    assert [n for n, _ in parse_quantiles("box,p50,0.999,median")] == ["p25", "p50", "p75", "iqr", "p99_9"]
    for bad in (dict(grid="x"), dict(overlap_rule="last"), dict(compact=True, partition="0/2"), dict(nodata_policy="emit", min_count=1.0), dict(emit_nodata_value=0.0), dict(compact=True, resolutions=(6, 7)), dict(transfer="overlay", sampling="rgss")):
        with pytest.raises(ValueError):
            ScanOptions(**bad)
