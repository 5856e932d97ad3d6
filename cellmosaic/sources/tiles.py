"""Map tiles of cells: cover of tiles, MVT encoding and PMTiles archives."""

from __future__ import annotations

import gzip
import json
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import healpix, wkb
from cellmosaic.sources.scratch import filesystem

EXTENT = 4096
LAYER = "cells"
MAX_LATITUDE = 85.05112878


def mercator(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the unit square of web mercator, x eastward and y southward."""
    phi = np.radians(np.clip(lat, -MAX_LATITUDE, MAX_LATITUDE))
    return (lon + 180) / 360, (1 - np.log(np.tan(phi) + 1 / np.cos(phi)) / math.pi) / 2


def tile_cover(cells: DataFrame, depth: int, zoom: int) -> DataFrame:
    """Adds tile_x and tile_y for every tile that the bounding box of a cell's outline touches, however many."""
    n = 1 << zoom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            lon, lat = healpix.corners(ids, depth)
            mid, _ = healpix.centers(ids, depth)
            lon = np.where(lon - mid[:, None] > 180, lon - 360, np.where(lon - mid[:, None] < -180, lon + 360, lon))
            x, y = mercator(lon, lat)
            reach = [np.floor(v * n).astype(np.int64) for v in (x.min(axis=1), x.max(axis=1))] + [np.clip(np.floor(v * n), 0, n - 1).astype(np.int64) for v in (y.min(axis=1), y.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, reach)], [*batch.schema.names, "_x0", "_x1", "_y0", "_y1"])

    fields = ", ".join(f"`{c}` {t}" for c, t in cells.dtypes)
    boxes = cells.mapInArrow(run, f"{fields}, _x0 long, _x1 long, _y0 long, _y1 long")
    # one after the other, so that no row holds all tiles of a wide cell
    rows = boxes.withColumn("tile_x", F.explode(F.sequence("_x0", F.least("_x1", F.col("_x0") + n - 1)))).withColumn("tile_y", F.explode(F.sequence("_y0", "_y1")))
    return rows.withColumn("tile_x", F.pmod("tile_x", F.lit(n))).drop("_x0", "_x1", "_y0", "_y1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v) -> bytes:
    if isinstance(v, bool):
        return b"\x38" + _varint(int(v))
    if isinstance(v, int):
        return b"\x28" + _varint(v) if v >= 0 else b"\x30" + _varint(_zigzag(v))
    if isinstance(v, float):
        return b"\x19" + struct.pack("<d", v)
    return _field(1, str(v).encode())


def encode_tile(features: list[tuple[int, list[tuple[int, int]], dict]]) -> bytes:
    """An MVT tile of polygons (id, ring in tile units, properties); null properties are left out."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = b""
    for number, ring, properties in features:
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v).__name__, v), len(values))) for k, v in properties.items() if v is not None)
        x, y = ring[0]
        geometry = _varint(1 | 1 << 3) + _varint(_zigzag(x)) + _varint(_zigzag(y)) + _varint(2 | len(ring) - 1 << 3)
        for px, py in ring[1:]:
            geometry += _varint(_zigzag(px - x)) + _varint(_zigzag(py - y))
            x, y = px, py
        geometry += _varint(7 | 1 << 3)
        body += _field(2, b"\x08" + _varint(number) + _field(2, tags) + b"\x18\x03" + _field(4, geometry))
    layer = _field(1, LAYER.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values) + b"\x28" + _varint(EXTENT) + b"\x78\x02"
    return _field(3, layer)


def tile_id(zoom: int, x: int, y: int) -> int:
    """Place along a Hilbert curve over the zoom's tiles, after all tiles of lower zooms."""
    d, s = 0, 1 << zoom >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & s - 1), s - 1 - (y & s - 1)
            x, y = y, x
        s >>= 1
    return ((1 << 2 * zoom) - 1) // 3 + d


def encoded_tiles(cells: DataFrame, depth: int, zoom: int, properties: list[str]) -> DataFrame:
    """(tile_id, zoom, tile_x, tile_y, features, data): one gzipped MVT tile per tile that has cells."""
    n = 1 << zoom

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tx, ty = key[0].as_py(), key[1].as_py()
        ids = table.column("cell").to_numpy()
        lon, lat = healpix.corners(ids, depth)
        mid = (tx + 0.5) / n * 360 - 180
        lon = lon - 360 * np.round((lon - mid) / 360)
        x, y = mercator(lon, lat)
        u, v = np.rint((x * n - tx) * EXTENT).astype(int), np.rint((y * n - ty) * EXTENT).astype(int)
        rows = table.select(properties).to_pylist()
        order = np.argsort(ids)
        features = [(int(ids[k]), [(int(a), int(b)) for a, b in zip(u[k][::-1], v[k][::-1], strict=True)], rows[k]) for k in order]
        data = gzip.compress(encode_tile(features), 6, mtime=0)
        return pa.table({"tile_id": pa.array([tile_id(zoom, tx, ty)], pa.int64()), "zoom": pa.array([zoom], pa.int32()), "tile_x": pa.array([tx], pa.int64()), "tile_y": pa.array([ty], pa.int64()), "features": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

    dealt = tile_cover(cells.select("cell", *properties), depth, zoom)
    return dealt.groupBy("tile_x", "tile_y").applyInArrow(run, "tile_id long, zoom int, tile_x long, tile_y long, features long, data binary")


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    out, last = _varint(len(entries)), 0
    for number, *_ in entries:
        out += _varint(number - last)
        last = number
    out += b"".join(_varint(run) for _, run, _, _ in entries) + b"".join(_varint(length) for _, _, length, _ in entries)
    for k, (_, _, _, offset) in enumerate(entries):
        follows = k and offset == entries[k - 1][3] + entries[k - 1][2]
        out += _varint(0 if follows else offset + 1)
    return gzip.compress(out, 6, mtime=0)


def write_pmtiles(tiles: DataFrame, path: str, metadata: dict | None = None) -> int:
    """Write encoded tiles to one PMTiles v3 archive in order of tile id; returns how many.

    Tasks write the tile bodies, sorted, to files beside the archive and return places and lengths, of which the directory is
    made; then those files are copied behind it one after the other, as an archive is a single file.
    """
    store, name = filesystem(path)
    store.create_dir(f"{name}.parts", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(f"{path}.parts")
        part, out = f"{folder}/{uuid.uuid4().hex}", None
        for batch in batches:
            out = out or store.open_output_stream(part, compression=None)
            data = batch.column(2)
            for body in data:
                out.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(batch)), batch.column(0), batch.column(1), pc.binary_length(data).cast(pa.int64())], ["part", "tile_id", "zoom", "length"])
        if out:
            out.close()

    ordered = tiles.repartitionByRange("tile_id").sortWithinPartitions("tile_id").select(F.col("tile_id").cast("long"), F.col("zoom").cast("int"), "data")
    written = ordered.mapInArrow(run, "part string, tile_id long, zoom int, length long").toArrow()
    parts, zooms = written.column("part").to_pylist(), written.column("zoom").to_pylist()
    number, length = written.column("tile_id").to_pylist(), written.column("length").to_pylist()
    first = {}
    for p, t in zip(parts, number, strict=True):
        first[p] = min(first.get(p, t), t)
    entries, sizes = [], 0
    for k in sorted(range(len(parts)), key=lambda k: (first[parts[k]], number[k])):
        if entries and entries[-1][0] >= number[k]:
            raise ValueError(f"tile {number[k]} occurs twice")
        entries.append((number[k], 1, length[k], sizes))
        sizes += length[k]
    root, leaves, step = _directory(entries), b"", 4096
    while len(root) > 16384 - 127:
        leaves, upper = b"", []
        for k in range(0, len(entries), step):
            leaf = _directory(entries[k : k + step])
            upper.append((entries[k][0], 0, len(leaf), len(leaves)))
            leaves += leaf
        root, step = _directory(upper), int(step * 1.2)
    about = gzip.compress(json.dumps({"vector_layers": [{"id": LAYER, "fields": {}}], **(metadata or {})}).encode(), 6, mtime=0)
    at_meta = 127 + len(root)
    at_leaves = at_meta + len(about)
    at_data = at_leaves + len(leaves)
    degrees = lambda *v: struct.pack(f"<{len(v)}i", *(round(x * 1e7) for x in v))
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(root), at_meta, len(about), at_leaves, len(leaves), at_data, sizes, len(entries), len(entries), len(entries))
    head += bytes([1, 2, 2, 1, min(zooms, default=0), max(zooms, default=0)]) + degrees(-180, -MAX_LATITUDE, 180, MAX_LATITUDE) + bytes([min(zooms, default=0)]) + degrees(0, 0)
    with store.open_output_stream(name, compression=None) as out:
        out.write(head + root + about + leaves)
        for part in sorted(first, key=first.get):
            with store.open_input_stream(part, compression=None) as f:
                while block := f.read(1 << 22):
                    out.write(block)
    store.delete_dir(f"{name}.parts")
    return len(entries)


def read_pmtiles(data: bytes) -> dict[int, bytes]:
    """Tiles of an archive by id, inflated."""
    root_at, root_len, _, _, leaf_at, _, data_at, _ = struct.unpack_from("<8Q", data, 8)

    def entries(raw: bytes) -> list[list[int]]:
        raw, at = gzip.decompress(raw), 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = raw[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        count = number()
        columns = [[number() for _ in range(count)] for _ in range(4)]
        out, last = [], 0
        for k in range(count):
            last += columns[0][k]
            offset = columns[3][k] - 1 if columns[3][k] else out[-1][3] + out[-1][2]
            out.append([last, columns[1][k], columns[2][k], offset])
        return out

    found = {}
    for number, run, length, offset in entries(data[root_at : root_at + root_len]):
        for n2, r2, l2, o2 in [(number, run, length, offset)] if run else entries(data[leaf_at + offset : leaf_at + offset + length]):
            for k in range(r2):
                found[n2 + k] = gzip.decompress(data[data_at + o2 : data_at + o2 + l2])
    return found


def decode_tile(data: bytes) -> list[tuple[int, list[tuple[int, int]], dict]]:
    """Features of a tile's one layer, as encode_tile takes them."""

    def fields(raw: bytes) -> Iterator[tuple[int, object]]:
        at = 0
        while at < len(raw):
            tag, at = number(raw, at)
            if tag & 7 == 2:
                n, at = number(raw, at)
                yield tag >> 3, raw[at : at + n]
                at += n
            elif tag & 7 == 1:
                yield tag >> 3, struct.unpack_from("<d", raw, at)[0]
                at += 8
            else:
                v, at = number(raw, at)
                yield tag >> 3, v

    def number(raw: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    def numbers(raw: bytes) -> list[int]:
        out, at = [], 0
        while at < len(raw):
            v, at = number(raw, at)
            out.append(v)
        return out

    plain = lambda z: (z >> 1) ^ -(z & 1)
    layer = next(v for k, v in fields(data) if k == 3)
    keys = [v.decode() for k, v in fields(layer) if k == 3]
    values = []
    for raw in (v for k, v in fields(layer) if k == 4):
        k, v = next(fields(raw))
        values.append(v.decode() if k == 1 else plain(v) if k == 6 else bool(v) if k == 7 else v)
    out = []
    for raw in (v for k, v in fields(layer) if k == 2):
        parts = dict(fields(raw))
        tags, geometry = numbers(parts.get(2, b"")), numbers(parts[4])
        ring, x, y, at = [], 0, 0, 0
        while at < len(geometry):
            command, count = geometry[at] & 7, geometry[at] >> 3
            at += 1
            for _ in range(count if command < 7 else 0):
                x, y, at = x + plain(geometry[at]), y + plain(geometry[at + 1]), at + 2
                ring.append((x, y))
        out.append((parts[1], ring, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}))
    return out


def with_outline(cells: DataFrame, depth: int) -> DataFrame:
    """Adds wkb, the cell's outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lon, lat = healpix.corners(batch.column(batch.schema.get_field_index("cell")).to_numpy(), depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([wkb.cell_outline(a, b) for a, b in zip(lon, lat, strict=True)], pa.binary())], [*batch.schema.names, "wkb"])

    return cells.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in cells.dtypes) + ", wkb binary")


# Fixed values of the format: longitude and latitude on WGS84, in this order.
_CRS84 = {
    "type": "GeographicCRS", "name": "WGS 84 (CRS84)", "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
    "coordinate_system": {"subtype": "ellipsoidal", "axis": [{"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}, {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"}]}, "id": {"authority": "OGC", "code": "CRS84"},
}


def write_geoparquet(cells: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write cells with a wkb column as GeoParquet 1.1 files sorted by cell; returns (file, rows) of each file.

    Each file says the box and the kinds of its own outlines, and that coordinates are longitude and latitude (OGC:CRS84, the format's
    default). Spark's writer can't set the footer key `geo`, so tasks write their files with pyarrow.
    """

    def described(box: list[float], kinds: set[str]) -> str:
        return json.dumps({"version": "1.1.0", "primary_column": "wkb", "columns": {"wkb": {"encoding": "WKB", "geometry_types": sorted(kinds), "edges": "planar", "orientation": "counterclockwise", "bbox": box, "crs": _CRS84}}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)
        name, writer, rows, box, kinds = f"{folder}/part-{uuid.uuid4().hex}.parquet", None, 0, [180.0, 90.0, -180.0, -90.0], set()
        for batch in batches:
            if writer is None:
                writer = parquet.ParquetWriter(name, batch.schema, filesystem=store, compression="zstd")
            writer.write_batch(batch)
            rows += batch.num_rows
            for shape in batch.column(batch.schema.get_field_index("wkb")):
                if shape.is_valid:
                    rings = [ring for poly in wkb.read_rings(shape.as_py()) for ring in poly]
                    low, high = np.min([r.min(axis=0) for r in rings], axis=0), np.max([r.max(axis=0) for r in rings], axis=0)
                    box = [min(box[0], float(low[0])), min(box[1], float(low[1])), max(box[2], float(high[0])), max(box[3], float(high[1]))]
                    kinds.add("MultiPolygon" if shape.as_py()[1] == 6 else "Polygon")
        if writer:
            writer.add_key_value_metadata({"geo": described(box, kinds)})
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["file", "rows"])

    dealt = cells.repartitionByRange(files, "cell") if files else cells.repartitionByRange("cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(run, "file string, rows long")


def write_jsonl(cells: DataFrame, path: str) -> None:
    """A JSON object per row, keys in order of name; binary as hex, numbers that aren't finite as null."""
    columns = []
    for c, t in sorted(cells.dtypes):
        column = F.col(c)
        if t == "binary":
            column = F.lower(F.hex(column))
        elif t in ("double", "float"):
            column = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
        columns.append(column.alias(c))
    cells.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
