"""Rasters from a server that counts requests, fails, and changes its files."""

from __future__ import annotations

import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from cellmosaic.sources import formats, geotiff, http

VALUES = (np.arange(512 * 512).reshape(512, 512) % 1000).astype("f4")


class Server:
    def __init__(self):
        self.files, self.version, self.log, self.failures, self.ranges, self.cut = {}, 1, [], 0, True, 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):
                outer.log.append(self.headers.get("Range"))
                if outer.failures > 0:
                    outer.failures -= 1
                    return self.send_error(503)
                data = outer.files.get(self.path)
                if data is None:
                    return self.send_error(404)
                if self.headers.get("If-Match") not in (None, f'"v{outer.version}"'):
                    return self.send_error(412)
                m = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
                a, b = (int(m[1]), min(int(m[2]) + 1, len(data))) if m and outer.ranges else (0, len(data))
                if a >= len(data):
                    return self.send_error(416)
                self.send_response(206 if m and outer.ranges else 200)
                self.send_header("ETag", f'"v{outer.version}"')
                self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
                short = outer.cut > 0
                outer.cut -= short
                self.send_header("Content-Length", str(b - a - (10 if short else 0)))
                self.end_headers()
                self.wfile.write(data[a : b - (10 if short else 0)])

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"


@pytest.fixture
def server():
    made = Server()
    made.files["/a.tif"] = geotiff.write_geotiff(VALUES, (0, 50), (0.01, 0.01), tile=32, compression=geotiff.NONE, nodata=-1.0)
    yield made
    made.http.shutdown()


def values(reader):
    out = np.full(VALUES.shape, np.nan, "f4")
    for p in reader.partitions():
        for b in reader.read(p):
            out[b.column("row").to_numpy(), b.column("col").to_numpy()] = b.column("value").to_numpy(zero_copy_only=False)
    return out


def test_few_requests(server):
    reader = geotiff.PixelReader({"path": f"{server.url}/a.tif", "target_chunks": "64"})
    parts = reader.partitions()
    assert len(server.log) <= 3 and len(parts) == 4  # header and directory
    before = len(server.log)
    got = values(reader)
    assert (got == VALUES).all()
    # of 256 chunks: for each partition the version, its neighbours as one request, and what planning again needs
    assert len(server.log) - before <= 3 + 4 * 3


def test_only_wanted_bytes(server):
    reader = geotiff.PixelReader({"path": f"{server.url}/a.tif", "bbox": "0,49.7,0.3,50", "target_chunks": "4"})
    for p in reader.partitions():
        assert len(list(reader.read(p))) == 1
    read = sum(int(b) - int(a) + 1 for a, b in (re.findall(r"\d+", r) for r in server.log))
    assert read < 0.35 * len(server.files["/a.tif"])


def test_passing_failures_are_tried_again(server, monkeypatch):
    monkeypatch.setattr(http, "PAUSE", 0.001)
    server.failures, server.cut = 3, 0
    assert (values(geotiff.PixelReader({"path": f"{server.url}/a.tif"})) == VALUES).all()
    server.cut = 2
    assert (values(geotiff.PixelReader({"path": f"{server.url}/a.tif"})) == VALUES).all()
    server.failures = 100
    with pytest.raises(OSError, match="no answer after"):
        geotiff.read_info(f"{server.url}/a.tif")


def test_a_changed_file_is_an_error(server):
    reader = geotiff.PixelReader({"path": f"{server.url}/a.tif", "target_chunks": "64"})
    parts = reader.partitions()
    with http.HttpFile(f"{server.url}/a.tif") as f:
        f.read_at(10, 200_000)
        server.version = 2
        assert len(f.read_at(10, 200_010)) == 10  # held
        with pytest.raises(http.ChangedFile):
            f.read_at(10, 700_000)
    with pytest.raises(ValueError, match="has changed"):
        list(reader.read(parts[0]))


def test_other_answers(server):
    with pytest.raises(FileNotFoundError):
        geotiff.read_info(f"{server.url}/none.tif")
    server.ranges = False
    with pytest.raises(ValueError, match="doesn't answer ranges"):
        geotiff.read_info(f"{server.url}/a.tif")


def test_budget_and_order(server):
    """Whatever the budget and the order of reads, each range comes once and is right."""
    data = server.files["/a.tif"]
    ranges = [(k * 4000 + 300, 1000 + 7 * (k % 50)) for k in range(200)]
    for budget in (1, 20_000, 1 << 30):
        with http.HttpFile(f"{server.url}/a.tif", budget) as f:
            f.prefetch(ranges)
            held = sum(a.end - a.start for a in f.running)
            assert held <= max(budget, http.MOST)
            for at, n in ranges if budget > 1 else ranges[::-1]:
                assert f.read_at(n, at) == data[at : at + n]
            assert f.read_at(50, len(data) - 20) == data[-20:] and f.read_at(5, len(data) + 5) == b""


def test_through_spark(spark, server):
    formats.register(spark)
    got = spark.read.format("raster_pixels").load(f"{server.url}/a.tif").agg({"value": "sum", "row": "count"}).first()
    assert got["sum(value)"] == float(VALUES.sum(dtype="f8")) and got["count(row)"] == VALUES.size
