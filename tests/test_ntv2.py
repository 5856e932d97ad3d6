"""Shift grids: nesting, both byte orders, there and back, and damaged files."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from cellmosaic.functions import ntv2


def grid(name, parent, west, south, columns, rows, step, base):
    r, c = np.mgrid[:rows, :columns]
    return ntv2.ShiftGrid(name, parent, south, south + (rows - 1) * step, west, west + (columns - 1) * step, step, step, np.dstack([base + 1e-4 * r + 2e-4 * c, -base + 3e-5 * r * c]))


def nested():
    return [grid("WIDE", "NONE", -10, 40, 21, 11, 1.0, 1e-3), grid("CHILD", "WIDE", -4, 43, 13, 13, 0.25, 5e-3), grid("SMALL", "CHILD", -3, 44, 11, 11, 0.05, 9e-3), grid("OTHER", "NONE", 20, -5, 5, 5, 0.5, 2e-3)]


@pytest.mark.parametrize("big", [False, True])
def test_the_smallest_grid_counts(big):
    made = nested()
    read = ntv2.parse(ntv2.write(made, big=big))
    assert [g.name for g in read] == ["SMALL", "CHILD", "OTHER", "WIDE"] and [g.depth for g in read] == [2, 1, 0, 0]
    lon, lat = np.array([-9.5, -3.9, -2.9, 21.0, 15.0, -10.0, 10.0]), np.array([41.5, 43.1, 44.1, -4.0, 45.0, 40.0, 50.0])
    got = ntv2.shifts(read, lon, lat)
    assert np.isnan(got[4]).all()
    for k, own in ((0, made[0]), (1, made[1]), (2, made[2]), (3, made[3]), (5, made[0]), (6, made[0])):
        x, y = (lon[k] - own.west) / own.lon_step, (lat[k] - own.south) / own.lat_step
        base = {"WIDE": 1e-3, "CHILD": 5e-3, "SMALL": 9e-3, "OTHER": 2e-3}[own.name]
        # both shifts are bilinear functions, so they are met between nodes as at them
        assert got[k] == pytest.approx([base + 1e-4 * y + 2e-4 * x, -base + 3e-5 * x * y], abs=1e-9)


def test_there_and_back():
    grids = ntv2.parse(ntv2.write(nested()))
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-9.5, 9.5, 2000), rng.uniform(40.5, 49.5, 2000)
    x, y = ntv2.forward(grids, lon, lat)
    a, b = ntv2.back(grids, x, y)
    settled = np.isfinite(a)
    # beside a child's edge the shift jumps, so that there may be two ways back or none
    u, v = ntv2.forward(grids, a[settled], b[settled])
    assert settled.mean() > 0.98 and np.abs(u - x[settled]).max() < 1e-8 and np.abs(v - y[settled]).max() < 1e-8
    assert (np.abs(a - lon) < 1e-8).mean() > 0.97 and (np.abs(b - lat) < 1e-8).mean() > 0.97
    assert np.isnan(ntv2.back(grids, np.array([100.0]), np.array([0.0]))[0]).all()


def test_over_rows(spark, tmp_path):
    (tmp_path / "g.gsb").write_bytes(ntv2.write(nested()))
    rows = spark.createDataFrame([(1, -9.5, 41.5), (2, -2.9, 44.1), (3, 100.0, 0.0), (4, None, 1.0), (5, float("nan"), 45.0)], "k int, lon double, lat double")
    there = ntv2.with_shift(rows, str(tmp_path / "g.gsb"))
    got = {r["k"]: r for r in there.collect()}
    assert all(got[k]["lon"] is None and got[k]["lat"] is None for k in (3, 4, 5)) and there.columns == ["k", "lon", "lat"]
    again = {r["k"]: r for r in ntv2.with_shift(there, str(tmp_path / "g.gsb"), inverse=True).collect()}
    assert (again[1]["lon"], again[2]["lat"]) == (pytest.approx(-9.5, abs=1e-9), pytest.approx(44.1, abs=1e-9))
    assert there.agg(ntv2.failed(there["lat"])).first()[0] == 3


def test_damaged_files_are_errors():
    good = ntv2.write(nested())
    at = lambda name, k=0: [i for i in range(0, len(good), 16) if good[i : i + 8].strip() == name][k] + 8
    put = lambda place, value: good[:place] + value + good[place + len(value) :]
    for bad in (b"", good[:100], good[:1000], put(0, b"XXXXXXXX"), put(at(b"GS_TYPE"), b"FEET    "), put(at(b"GS_COUNT"), struct.pack("<i", 7)), put(at(b"LAT_INC"), struct.pack("<d", 0.0)), put(at(b"PARENT", 1), b"NOBODY  "), put(at(b"SUB_NAME", 1), b"WIDE    "), put(at(b"PARENT", 0), b"SMALL   "), put(at(b"GS_COUNT") + 8, struct.pack("<f", float("nan")))):
        with pytest.raises(ValueError, match="invalid NTv2"):
            ntv2.parse(bad)
