"""GeoTIFF files: decoding of chunks, writing, and a PySpark data source of pixel rows.

Classic and BigTIFF; strips and tiles; interleaved and separate bands; no compression, Deflate, LZW, ZSTD and PackBits;
predictors 1 to 3; GDAL NoData, scale and offset; sparse chunks; alpha bands and internal masks. Chunks are read one at a time by
byte range.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cellmosaic.functions import bounds
from cellmosaic.sources.scratch import filesystem

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, table, width, prefix = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        codes.append((table[prefix], width))
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, width))
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        prefix = data[k : k + 1]
    if prefix:
        codes.append((table[prefix], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    value = bits = 0
    out = bytearray()
    for code, w in codes:
        value, bits = (value << w) | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits))
    return bytes(out)


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if kind == LZW:
        return unpack_lzw(data)
    if kind == PACKBITS:
        return unpack_bits(data)
    if kind == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    raise ValueError(f"unsupported TIFF compression {kind}")


def unpredict(data: bytes, predictor: int, dtype: np.dtype, height: int, width: int, samples: int) -> np.ndarray:
    """Decoded samples (row, column, sample) in the machine's byte order."""
    native = dtype.newbyteorder("=")
    if predictor == 3:
        size = dtype.itemsize
        rows = np.frombuffer(data, np.uint8).reshape(height, size * width * samples)
        # byte planes, most significant first, differenced across all samples of a row
        summed = np.cumsum(rows.reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, size, width * samples)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).astype(native).reshape(height, width, samples)
    out = np.frombuffer(data, dtype)[: height * width * samples].reshape(height, width, samples).astype(native)
    if predictor == 2:
        whole = out.view(f"u{dtype.itemsize}")
        out = np.cumsum(whole, axis=1, dtype=whole.dtype).view(native)
    return out


@dataclass
class TiffInfo:
    path: str
    width: int
    height: int
    bands: int
    dtype: np.dtype
    order: str
    compression: int
    predictor: int
    planar: bool
    tiled: bool
    chunk_width: int
    chunk_height: int
    offsets: list[int] | dict[int, int]
    sizes: list[int] | dict[int, int]
    origin: tuple[float, float]
    pixel: tuple[float, float]
    epsg: int | None
    nodata: float | None
    scale: dict[int, tuple[float, float]] = field(default_factory=dict)
    alpha: int | None = None
    bits: int = 0  # 1 for masks of one bit a pixel
    mask: TiffInfo | None = None
    version: str | None = None  # of a file that can change while it is read

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_width)

    @property
    def chunks(self) -> int:
        return self.across * -(-self.height // self.chunk_height)

    def box(self, chunk: int) -> tuple[int, int, int, int]:
        """Column, row, width and height of a chunk, clipped at the raster's edge."""
        r, c = divmod(chunk, self.across)
        col, row = c * self.chunk_width, r * self.chunk_height
        return col, row, min(self.chunk_width, self.width - col), min(self.chunk_height, self.height - row)

    def chunks_in(self, col: int, row: int, width: int, height: int) -> list[int]:
        """Chunks that a box of pixels meets."""
        across = range(col // self.chunk_width, (col + width - 1) // self.chunk_width + 1)
        return [r * self.across + c for r in range(row // self.chunk_height, (row + height - 1) // self.chunk_height + 1) for c in across]

    def only(self, chunks: list[int], bands: list[int]) -> TiffInfo:
        """The same with the places of those chunks and bands alone, so that a partition carries no more than it reads."""
        keys = {c + (b - 1) * self.chunks for c in chunks for b in bands} if self.planar else set(chunks)
        mask = self.mask and self.mask.only(sorted({m for c in chunks for m in self.mask.chunks_in(*self.box(c))}), [1])
        return replace(self, offsets={k: self.offsets[k] for k in keys}, sizes={k: self.sizes[k] for k in keys}, mask=mask)


def _directory(f, order: str, big: bool, at: int) -> tuple[dict[int, object], int]:
    """Tags of the image whose directory is there, and where the next directory is (0: none)."""
    word = "Q" if big else "I"
    n = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, at))[0]
    at += 8 if big else 2
    size, inline = (20, 8) if big else (12, 4)
    raw = f.read_at(n * size + inline, at)
    tags: dict[int, object] = {}
    for k in range(n):
        entry = raw[k * size : (k + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + word, entry[4 : 12 if big else 8])[0]
        code = _TYPES.get(kind, "B")
        length = count * struct.calcsize(order + code)
        value = entry[-inline:][:length] if length <= inline else f.read_at(length, struct.unpack(order + word, entry[-inline:])[0])
        tags[tag] = value.rstrip(b"\0").decode("latin-1") if code == "s" else list(struct.unpack(f"{order}{count * len(code)}{code[0]}", value))
    return tags, struct.unpack(order + word, raw[n * size :].ljust(inline, b"\0"))[0]


def read_info(path: str) -> TiffInfo:
    """The first image's tags and those of its internal mask; an invalid scale is an error."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
        tags, at = _directory(f, order, big, at)
        info, seen = _image(path, order, tags), set()
        info.version = getattr(f, "version", None)
        while at and at not in seen:
            seen.add(at)
            more, at = _directory(f, order, big, at)
            # a transparency mask of this image, not of one of its overviews
            if more.get(254, [0])[0] & 4 and (more[256][0], more[257][0]) == (info.width, info.height):
                info.mask = _image(path, order, more)
                break
    return info


def _image(path: str, order: str, tags: dict[int, object]) -> TiffInfo:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    bands, tiled, bits = one(277, 1), 322 in tags, one(258, 1)
    if bits not in (1, 8, 16, 32, 64):
        raise ValueError(f"{path}: samples of {bits} bits are not supported")
    dtype = np.dtype(f"{order}{_KINDS[one(339, 1)]}{max(bits // 8, 1)}")
    keys = tags.get(34735, [])
    epsg = next((keys[k + 3] for want in (3072, 2048) for k in range(4, len(keys), 4) if keys[k] == want and keys[k + 1] == 0 and keys[k + 3] != 32767), None)
    tie, pixel = tags.get(33922, [0.0] * 6), tags.get(33550, [1.0, 1.0, 0.0])
    scale: dict[int, list[float]] = {}
    for m in re.finditer(r'<Item name="(?:SCALE|OFFSET)" sample="(\d+)" role="(scale|offset)">([^<]+)</Item>', tags.get(42112, "")):
        scale.setdefault(int(m[1]) + 1, [1.0, 0.0])[m[2] == "offset"] = float(m[3])
    for s, o in scale.values():
        if s == 0 or not np.isfinite([s, o]).all():
            raise ValueError(f"{path}: invalid scale or offset")
    extra = tags.get(338, [])
    alpha = next((bands - len(extra) + k + 1 for k, x in enumerate(extra) if x in (1, 2)), None)
    return TiffInfo(
        path, one(256), one(257), bands, dtype, order, one(259, 1), one(317, 1), one(284, 1) == 2, tiled, one(322) if tiled else one(256), one(323) if tiled else min(one(278, one(257)), one(257)),
        tags.get(324 if tiled else 273), tags.get(325 if tiled else 279), (tie[3] - tie[0] * pixel[0], tie[4] + tie[1] * pixel[1]), (pixel[0], pixel[1]), epsg,
        float(tags[42113]) if 42113 in tags else None, {b: tuple(v) for b, v in scale.items()}, alpha, 1 if bits == 1 else 0,
    )


def read_chunk(f, info: TiffInfo, chunk: int, bands: list[int]) -> np.ndarray | None:
    """Stored samples (row, column, band) of a chunk for bands counted from 1; None if it is absent."""
    _, _, w, h = info.box(chunk)
    full_h = info.chunk_height if info.tiled else h
    planes = []
    for k in [chunk + (b - 1) * info.chunks for b in bands] if info.planar else [chunk]:
        if not info.sizes[k]:
            return None
        samples = 1 if info.planar else info.bands
        if info.bits:
            packed = -(-info.chunk_width * samples // 8)
            data = decompress(f.read_at(info.sizes[k], info.offsets[k]), info.compression, full_h * packed)
            bits = np.unpackbits(np.frombuffer(data, np.uint8)[: full_h * packed].reshape(full_h, packed), axis=1)
            planes.append(bits[:, : info.chunk_width * samples].reshape(full_h, info.chunk_width, samples)[:h, :w])
            continue
        size = full_h * info.chunk_width * samples * info.dtype.itemsize
        data = decompress(f.read_at(info.sizes[k], info.offsets[k]), info.compression, size)
        planes.append(unpredict(data, info.predictor, info.dtype, full_h, info.chunk_width, samples)[:h, :w])
    return np.concatenate(planes, axis=2) if info.planar else planes[0][:, :, [b - 1 for b in bands]]


def read_mask(f, info: TiffInfo, chunk: int) -> np.ndarray:
    """Whether the internal mask lets each pixel of a chunk count; absent chunks of the mask count as zeros, which hide."""
    col, row, w, h = info.box(chunk)
    out = np.zeros((h, w), dtype=bool)
    for k in info.mask.chunks_in(col, row, w, h):
        got = read_chunk(f, info.mask, k, [1])
        if got is not None:
            c, r, cw, ch = info.mask.box(k)
            c0, c1, r0, r1 = max(c, col), min(c + cw, col + w), max(r, row), min(r + ch, row + h)
            out[r0 - row : r1 - row, c0 - col : c1 - col] = got[r0 - r : r1 - r, c0 - c : c1 - c, 0] != 0
    return out


def write_geotiff(
    values: np.ndarray, origin: tuple[float, float], pixel: tuple[float, float], epsg: int = 4326, tile: int | None = None, compression: int = DEFLATE, predictor: int = 1,
    planar: bool = False, nodata: float | None = None, scale: dict[int, tuple[float, float]] | None = None, alpha: bool = False, rows_per_strip: int = 64, big: bool = False, sparse: frozenset[int] = frozenset(), mask: np.ndarray | None = None,
) -> bytes:
    """A little-endian GeoTIFF of (row, column[, band]) samples; a mask (row, column) becomes a second image of one bit a pixel."""
    values = values[:, :, None] if values.ndim == 2 else values
    height, width, bands = values.shape
    dtype = values.dtype.newbyteorder("<")
    cw, ch = (tile, tile) if tile else (width, rows_per_strip)
    chunks = []
    for plane in ([values[:, :, b : b + 1] for b in range(bands)] if planar else [values]):
        for row in range(0, height, ch):
            for col in range(0, width, cw):
                if len(chunks) in sparse:
                    chunks.append(b"")
                    continue
                block = plane[row : row + ch, col : col + cw]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                h, w, n = block.shape
                if predictor == 3:
                    planes = block.astype(values.dtype.newbyteorder(">")).reshape(h, w * n, 1).view(np.uint8).transpose(0, 2, 1).reshape(h, -1, n)
                    data = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
                elif predictor == 2:
                    whole = np.ascontiguousarray(block).view(f"u{dtype.itemsize}")
                    data = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1).tobytes()
                else:
                    data = block.astype(dtype).tobytes()
                if compression in (DEFLATE, OLD_DEFLATE):
                    data = zlib.compress(data, 6)
                elif compression == LZW:
                    data = pack_lzw(data)
                elif compression == PACKBITS:
                    data = b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128))
                elif compression == ZSTD:
                    import zstandard

                    data = zstandard.ZstdCompressor().compress(data)
                chunks.append(data)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    geographic = epsg in (4326, 4269)
    tags: dict[int, tuple[int, object]] = {
        256: (4, [width]), 257: (4, [height]), 258: (3, [dtype.itemsize * 8] * bands), 259: (3, [compression]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [2 if planar else 1]), 317: (3, [predictor]), 339: (3, [kind] * bands),
        33550: (12, [pixel[0], pixel[1], 0.0]), 33922: (12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), 34735: (3, [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg]),
    }
    if bands > 1:
        tags[338] = (3, [0] * (bands - 2) + [2 if alpha else 0])
    tags |= {322: (4, [tile]), 323: (4, [tile])} if tile else {278: (4, [rows_per_strip])}
    if nodata is not None:
        tags[42113] = (2, f"{nodata:g}\0".encode())
    if scale:
        items = "".join(f'<Item name="{n.upper()}" sample="{b - 1}" role="{n}">{v!r}</Item>' for b, pair in scale.items() for n, v in zip(("scale", "offset"), pair, strict=True))
        tags[42112] = (2, f"<GDALMetadata>{items}</GDALMetadata>\0".encode())
    images = [(tags, chunks, 324 if tile else 273)]
    if mask is not None:
        strips = [zlib.compress(np.packbits(mask[row : row + rows_per_strip].astype(bool), axis=1).tobytes()) for row in range(0, height, rows_per_strip)]
        images.append(({254: (4, [4]), 256: (4, [width]), 257: (4, [height]), 258: (3, [1]), 259: (3, [DEFLATE]), 262: (3, [4]), 277: (3, [1]), 278: (4, [rows_per_strip])}, strips, 273))
    word, start = "Q" if big else "I", 16 if big else 8
    body, directories = bytearray(), []
    for own, data, places in images:
        where = []
        for x in data:
            where.append(start + len(body) if x else 0)
            body += x
        directories.append(own | {places: (16 if big else 4, where), (325 if places == 324 else 279): (16 if big else 4, [len(x) for x in data])})
    at = first = start + len(body)
    out = b""
    for k, own in enumerate(directories):
        entries, extra = b"", bytearray()
        after = at + (8 + 20 * len(own) + 8 if big else 2 + 12 * len(own) + 4)
        for tag, (code, value) in sorted(own.items()):
            data = value if code == 2 else struct.pack(f"<{len(value)}{_TYPES[code]}", *value)
            count, room = len(value), 8 if big else 4
            if len(data) > room:
                place = struct.pack("<" + word, after + len(extra))
                extra += data
            else:
                place = data.ljust(room, b"\0")
            entries += struct.pack("<HH" + word, tag, code, count) + place
        at = after + len(extra)
        out += struct.pack("<Q" if big else "<H", len(own)) + entries + struct.pack("<" + word, at if k + 1 < len(directories) else 0) + bytes(extra)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first)
    return bytes(head) + bytes(body) + out


def resolve(path: str) -> list[str]:
    """Files of a path, a comma list, a folder, a * pattern or a VRT file, in order."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in path.split(","))):
        store, name = filesystem(part)
        prefix = part[: len(part) - len(name)] if part.endswith(name) else ""
        if part.endswith(".vrt"):
            with store.open_input_stream(name) as f:
                found = re.findall(r'<SourceFilename(?:\s+relativeToVRT="(\d)")?[^>]*>([^<]+)</SourceFilename>', f.read().decode())
            out += list(dict.fromkeys(f"{part.rpartition('/')[0]}/{x}" if relative == "1" else x for relative, x in found))
        elif "*" in name:
            from pyarrow import fs

            folder, _, pattern = name.rpartition("/")
            wanted = re.compile(re.escape(pattern).replace(r"\*", ".*"))
            out += sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(folder)) if wanted.fullmatch(i.base_name))
        elif store.get_file_info(name).type.name == "Directory":
            from pyarrow import fs

            out += sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(name)) if i.extension.lower() in ("tif", "tiff"))
        else:
            out.append(part)
    return out


#: Up to so many files are opened while planning; beyond, planning needs only their sizes, and tasks read the headers.
MOST_OPENED = 256


@dataclass
class ChunkRun(InputPartition):
    tile: int
    info: TiffInfo
    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.tile, self.first))


@dataclass
class FileShare(InputPartition):
    """The part-th of so many equal runs of a file's chunks."""

    tile: int
    path: str
    part: int
    parts: int

    def __post_init__(self):
        super().__init__((self.tile, self.part))


class PixelReader(DataSourceReader):
    """Chunks that miss a pushed-down or given bbox are not read; partitions are runs of chunks of one file."""

    def __init__(self, options):
        self.options = options
        self.window = {"x": [-np.inf, np.inf], "y": [-np.inf, np.inf]}
        self.boxes = None
        if "bbox" in options:
            west, south, east, north = (float(v) for v in options["bbox"].split(","))
            # a box whose west is over its east lies across the antimeridian
            self.boxes = [(west, south, east, north)] if west <= east else [(west, south, np.inf, north), (-np.inf, south, east, north)]
        self.bands = [int(b) for b in options.get("bands", options.get("band", "1")).split(",")]
        self.globe = tuple(float(v) for v in options["lonlat_bbox"].split(",")) if "lonlat_bbox" in options else None

    def pushFilters(self, filters):
        for f in filters:
            axis = f.attribute[0] if len(f.attribute) == 1 else None
            if axis in self.window and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)):
                low, high = self.window[axis]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, float(f.value))
                self.window[axis] = [low, high]
            yield f  # chunks are pruned here, rows by Spark

    def partitions(self):
        paths = resolve(self.options["path"])
        if len(paths) > MOST_OPENED:
            out = [FileShare(tile, path, part, parts) for tile, (path, parts) in enumerate(zip(paths, self._shares(paths), strict=True)) for part in range(parts)]
            return self._own_run(out)
        target = int(self.options.get("target_chunks", "16"))
        out = []
        with ThreadPoolExecutor(16) as pool:
            for tile, info in enumerate(pool.map(self._opened, paths)):
                kept = self._kept(info, range(info.chunks))
                for at in range(0, len(kept), target):
                    run = kept[at : at + target]
                    cuts = [0, *(k for k in range(1, len(run)) if run[k] != run[k - 1] + 1), len(run)]
                    out += [ChunkRun(tile, info.only(run[a:b], self._wanted(info)), run[a], run[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return self._own_run(out)

    def _own_run(self, out: list) -> list:
        """All partitions, or with the option `partition` (k/n) the k-th of n runs of them."""
        k, n = (int(v) for v in self.options.get("partition", "0/1").split("/"))
        return out[len(out) * k // n : len(out) * (k + 1) // n] or [InputPartition(None)]

    def _shares(self, paths: list[str]) -> Iterator[int]:
        """Into how many parts each file is cut, by its size."""
        bytes_each = int(self.options.get("split_bytes", str(64 << 20)))
        with ThreadPoolExecutor(16) as pool:
            yield from pool.map(lambda path: max(1, -(-(lambda at: at[0].get_file_info(at[1]).size or 0)(filesystem(path)) // bytes_each)), paths)

    def _opened(self, path: str) -> TiffInfo:
        info = read_info(path)
        if max(self.bands) > info.bands:
            raise ValueError(f"{path} has {info.bands} bands")
        return info

    def _wanted(self, info: TiffInfo) -> list[int]:
        return self.bands + ([info.alpha] if info.alpha and info.alpha not in self.bands else [])

    def _kept(self, info: TiffInfo, chunks: range) -> list[int]:
        """Chunks that may hold wanted pixels: of a box in degrees, those whose certified bounds meet it."""
        col, row, w, h = np.array([info.box(k) for k in chunks], dtype=np.float64).reshape(-1, 4).T
        x0, y1 = info.origin[0] + col * info.pixel[0], info.origin[1] - row * info.pixel[1]
        x1, y0 = x0 + w * info.pixel[0], y1 - h * info.pixel[1]
        meets = lambda west, south, east, north: (x0 <= east) & (x1 >= west) & (y1 >= south) & (y0 <= north)
        (west, east), (south, north) = self.window["x"], self.window["y"]
        kept = meets(west, south, east, north)
        if self.boxes is not None:
            kept &= np.logical_or.reduce([meets(*box) for box in self.boxes])
        code = int(self.options["source_crs"]) if "source_crs" in self.options else info.epsg
        if self.globe is not None and code is not None:
            kept &= bounds.meets(code, (x0, y0, x1, y1), self.globe)
        return np.asarray(chunks)[kept].tolist() if len(chunks) else []

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if isinstance(part, FileShare):
            info = self._opened(part.path)
            chunks = self._kept(info, range(info.chunks * part.part // part.parts, info.chunks * (part.part + 1) // part.parts))
        elif isinstance(part, ChunkRun):
            info, chunks = part.info, range(part.first, part.last + 1)
        else:
            return
        store, name = filesystem(info.path)
        nodata = float(self.options["nodata"]) if "nodata" in self.options else info.nodata
        calibrate = self.options.get("scale_offset", "true").lower() != "false"
        wanted = self._wanted(info)
        with store.open_input_file(name) as f:
            if getattr(f, "version", None) != info.version:
                raise ValueError(f"{info.path} has changed since it was planned")
            if hasattr(f, "prefetch"):
                places = [c + (b - 1) * info.chunks for c in chunks for b in wanted] if info.planar else list(chunks)
                f.prefetch([(info.offsets[k], info.sizes[k]) for k in places])
            for chunk in chunks:
                got = read_chunk(f, info, chunk, wanted)
                if got is None:
                    continue
                col, row, w, h = info.box(chunk)
                valid = got[:, :, wanted.index(info.alpha)] != 0 if info.alpha else np.ones((h, w), dtype=bool)
                if info.mask:
                    valid = valid & read_mask(f, info, chunk)
                cols, rows = (v.ravel().astype(np.int64) for v in np.meshgrid(np.arange(col, col + w), np.arange(row, row + h)))
                x, y = info.origin[0] + (cols + 0.5) * info.pixel[0], info.origin[1] - (rows + 0.5) * info.pixel[1]
                kept = np.ones(w * h, dtype=bool) if self.boxes is None else np.logical_or.reduce([(x >= west) & (x <= east) & (y >= south) & (y <= north) for west, south, east, north in self.boxes])
                arrays = [pa.array(np.full(kept.sum(), part.tile, np.int32)), *(pa.array(v[kept]) for v in (cols, rows, x, y))]
                for k, band in enumerate(self.bands):
                    stored = got[:, :, k].astype(np.float64)
                    missing = ~valid
                    if nodata is not None:
                        close = np.isnan(stored) if np.isnan(nodata) else np.abs(stored - nodata) <= (1e-6 * max(1.0, abs(nodata)) if info.dtype.kind == "f" else 0)
                        missing = missing | close
                    scale, offset = info.scale.get(band, (1.0, 0.0)) if calibrate else (1.0, 0.0)
                    arrays.append(pa.array((stored * scale + offset).ravel()[kept], mask=missing.ravel()[kept]))
                if self._sized():
                    arrays += [pa.array(np.full(kept.sum(), info.pixel[k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["tile", "col", "row", "x", "y", *self._names()])

    def _sized(self) -> bool:
        return self.options.get("pixel_size", "false").lower() == "true"

    def _names(self) -> list[str]:
        return (["value"] if len(self.bands) == 1 else [f"band_{b}" for b in self.bands]) + (["px", "py"] if self._sized() else [])


class PixelSource(DataSource):
    """format("raster_pixels"): a row per pixel with tile, col, row, x, y of its centre, and value or band_N; NoData is null.

    Pixels that an alpha band or an internal mask hides are null too. Options: path, band or bands, nodata, scale_offset, bbox (of
    pixel centres in the file's CRS, edges included; west over east: across the antimeridian), lonlat_bbox (in degrees, whatever the file's
    CRS: chunks that can't hold a point of it are not read, the others whole), source_crs (in place of the file's), pixel_size (adds
    px, py), target_chunks, split_bytes, partition (k/n: the k-th of n runs of chunks).
    """

    @classmethod
    def name(cls) -> str:
        return "raster_pixels"

    def schema(self) -> str:
        return "tile int, col long, row long, x double, y double, " + ", ".join(f"{n} double" for n in PixelReader(self.options)._names())

    def reader(self, schema) -> PixelReader:
        return PixelReader(self.options)
