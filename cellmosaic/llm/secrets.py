"""Secret scans with a recursive decoding worklist.

Each text is scanned as it stands. Parts that look encoded (percent and \\u escapes, base64, and base64, hexadecimal or
percent-coded bytes of compressed streams) are decoded, all parts of one kind into one layer, which goes on a worklist until
nothing new decodes. A layer holds the decoded parts and the words around them, and for each character the place in the original
text that it came from; findings are reported there. A layer with the text and places of another is not scanned twice, so cycles
end, while the same text from elsewhere in the document is.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of reports: pattern, group that is measured, fewest characters of it. Fixed by the contract.
KINDS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # as [0-9a-f]+ with shorter matches dropped
}
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_WORDS = re.compile(r"(?ai:passw|secret|token|api_?key)")
#: A percent sign that is itself escaped any number of times (%2525...) is unwrapped in one step.
_PERCENT = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
_URL = re.compile(r"[A-Za-z0-9._~+/=:&?%-]+")
_ESCAPES = re.compile(r"(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2})+")
_ESCAPE = re.compile(r"\\[ux]([0-9a-fA-F]+?)(?=\\|\Z)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){18,}")
#: How compressed streams begin: gzip, zlib, bzip2, xz.
_STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\0")
_BROKEN = re.compile("[\udc80-\udcff]")
_WORD = re.compile(r"\S*")
_AFTER = re.compile(r"\S*(?:\x20+\S+){0,2}")
#: Bare base64 counts as text if at least this share of its characters is readable.
READABLE = 0.75
#: Unpacked streams of more bytes are scanned in windows of about as many characters, of which neighbours share SHARED whole words; of
#: a stream's text, OVERLAP characters or as many words from its begin and end stand in the layer.
WINDOW, OVERLAP, SHARED = 4 << 20, 1 << 16, 16
_FIRST_WORDS = re.compile(rf"(?:[^ \t\n\r]*+[ \t\n\r]++){{{SHARED}}}")


class Layer(NamedTuple):
    """Text; where the origin of each character begins and ends (None: the text is the original); its decoded parts, ascending."""

    text: str
    begins: np.ndarray | None
    ends: np.ndarray | None
    fresh: list[tuple[int, int]]


class Piece(NamedTuple):
    """A decoded part of a layer: its place, its text, the place of each character from the part's begin, and kinds known to be in it.

    Without places all characters come from the whole part.
    """

    start: int
    end: int
    text: str
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None
    kinds: frozenset[str] = frozenset()


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of findings, leftmost and non-overlapping per kind."""
    found = []
    if _WORDS.search(text):
        pattern, group, fewest = KINDS["assign"]
        found += [(m.start(), "assign", m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= fewest]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in KINDS["access"][0].finditer(text) if m.end() - m.start() >= KINDS["access"][2]]
    found += [(m.start(), "hex", m.end()) for m in KINDS["hex"][0].finditer(text)]
    return found


def _readable(text: str) -> bool:
    """Whether most of a text is characters that texts have, so that words which only look like base64 are let be."""
    return text.isprintable() or sum(c.isprintable() or c.isspace() or unicodedata.category(c) == "Cf" for c in text) >= READABLE * len(text)


def _by_bytes(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Bytes as text of UTF-8, and from the origin of each byte that of each character; bytes that are no text become U+FFFD."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return _BROKEN.sub("\ufffd", text), begins, ends
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.where((point < 0x80) | ((point >= 0xDC80) & (point <= 0xDCFF)), 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4)))
    until = np.cumsum(size)
    return _BROKEN.sub("\ufffd", text), begins[until - size], ends[until - 1]


# --- compressed streams ----------------------------------------------------------------------------------------------


def _unpacker(head: bytes):
    """What unpacks a stream that begins like this; None if it is none."""
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"x" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh" and head[4:10] == b"1AY&SY":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


class _Unpacked:
    """The streams, one after the other, that chunks of bytes begin with, unpacked a bounded chunk at a time.

    `used` counts the bytes of streams, `good` tells whether they count: zlib's head of two bytes is weak, so such a stream must
    come to its end; of the others what there is counts.
    """

    def __init__(self, source: Iterator[bytes]):
        self.source, self.used, self.good, self.fed = source, 0, False, 0

    def _more(self) -> bytes:
        more = next(self.source, b"")
        self.fed += len(more)
        return more

    def __iter__(self) -> Iterator[bytes]:
        held = b""
        while True:
            while len(held) < 10 and (more := self._more()):
                held += more
            if (stream := _unpacker(held)) is None:
                return
            self.good |= held[:1] != b"x"
            try:
                while not stream.eof:
                    part = stream.decompress(held, 1 << 20)
                    held = getattr(stream, "unconsumed_tail", b"")
                    if part:
                        yield part
                    elif not held and getattr(stream, "needs_input", True) and not (held := self._more()):
                        self.used = self.fed
                        return
            except (zlib.error, lzma.LZMAError, OSError, EOFError):
                self.used = self.used or self.fed
                return
            held = stream.unused_data
            self.good, self.used = True, self.fed - len(held)


def _in_windows(chunks: Iterator[bytes]) -> tuple[str, frozenset[str]]:
    """Head and tail of a long stream's text, and the kinds found in it, streams in it included. Equal windows are scanned once."""
    first = next(chunks, b"")
    while _unpacker(first[:10]) and next(iter(_Unpacked(iter([first]))), b""):
        chunks = iter(_Unpacked(itertools.chain([first], chunks)))
        first = next(chunks, b"")
    decoder, head, held, kinds, seen, enough = codecs.getincrementaldecoder("utf-8")("replace"), None, "", set(), set(), WINDOW
    for part in itertools.chain([first], chunks):
        held += decoder.decode(part)
        if len(held) < enough:
            continue
        end = _last_space(held, len(held))
        start = end
        for _ in range(SHARED):
            start = _last_space(held, start)
        if start < len(held) // 2:  # words as long as that are kept whole
            enough = 2 * len(held)
            continue
        head = _first_words(held) if head is None else head
        window, held, enough = held[:end], held[start:], WINDOW
        if (key := hashlib.blake2b(window.encode("utf-8", "replace"), digest_size=16).digest()) not in seen:
            seen.add(key)
            kinds |= {kind for _, kind, _ in find(window)[1]}
    kinds |= {kind for _, kind, _ in find(held)[1]}
    start = len(held)
    for _ in range(SHARED):
        start = _last_space(held, start)
    return f"{_first_words(held) if head is None else head}\n{held[min(start, max(0, len(held) - OVERLAP)):]}", frozenset(kinds)


def _last_space(text: str, until: int) -> int:
    """Place of the last space before one; 0 if there is none. No finding and no encoded part goes over more than a few words."""
    return max(0, *(text.rfind(c, 0, until) for c in " \t\n\r"))


def _first_words(text: str) -> str:
    words = _FIRST_WORDS.match(text)
    return text[: max(OVERLAP, words.end() if words else len(text))]


def _unpacked(data: bytes, start: int = 0) -> tuple[str, frozenset[str], int] | None:
    """The text in the streams that data has from a place on, streams in streams unwrapped; kinds in it if it is long; bytes used."""
    seen, used = set(), 0
    while _unpacker(data[start : start + 10]):
        stream = _Unpacked(data[k : k + (1 << 16)] for k in range(start, len(data), 1 << 16))
        chunks, parts, size = iter(stream), [], 0
        for part in chunks:
            parts.append(part)
            size += len(part)
            if size > WINDOW:
                text, kinds = _in_windows(itertools.chain(parts, chunks))
                return text, kinds, used or stream.used or len(data) - start
        if not parts or not stream.good:
            break
        used, start, data = used or stream.used, 0, b"".join(parts)
        if (key := hashlib.blake2b(data, digest_size=16).digest()) in seen:
            break  # a stream that unpacks to itself
        seen.add(key)
    return (data.decode("utf-8", "replace"), frozenset(), used) if used else None


def _deflated(data: bytes) -> tuple[str, frozenset[str]] | None:
    """The text of a deflate stream without head; as that could be anything, it must fill data and be readable."""

    def chunks(stream) -> Iterator[bytes]:
        held = data
        while not stream.eof and (part := stream.decompress(held, 1 << 20)):
            yield part
            held = stream.unconsumed_tail

    stream, first, size = zlib.decompressobj(-15), b"", 0
    try:
        for part in chunks(stream):
            first, size = first or part, size + len(part)
    except zlib.error:
        return None
    if not stream.eof or stream.unused_data or size < 8 or not _readable(first.decode("utf-8", "surrogateescape")):
        return None
    if size > WINDOW:
        return _in_windows(chunks(zlib.decompressobj(-15)))
    return b"".join(chunks(zlib.decompressobj(-15))).decode("utf-8", "replace"), frozenset()


# --- codecs: pieces of a layer that decode ---------------------------------------------------------------------------


def _touches(fresh: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a stretch overlaps one of the ascending parts."""
    k = bisect_left(fresh, (end,)) - 1
    return k >= 0 and fresh[k][1] > start


def _percent(layer: Layer) -> Iterator[Piece]:
    """Streams in percent-coded bytes, which may begin after a name, as in ?data=%1F%8B, and other escapes side by side."""
    for run in _URL.finditer(layer.text):
        if "%" not in run[0] or not _touches(layer.fresh, run.start(), run.end()):
            continue
        marks = [(m.start(), m.end(), int(m[0][-2:], 16)) for m in _PERCENT.finditer(run[0])]
        if not marks:
            continue
        begin, end, value = (np.array(x, dtype=np.int64) for x in zip(*marks, strict=True))
        taken = 0
        if (value >= 0x80).any():
            # one byte for each escape and each other character
            starts = np.ones(len(run[0]), dtype=bool)
            inside = np.zeros(len(run[0]) + 1, dtype=np.int64)
            np.add.at(inside, begin + 1, 1)
            np.add.at(inside, end, -1)
            starts[np.cumsum(inside)[:-1] > 0] = False
            at = np.flatnonzero(starts)
            data = np.frombuffer(run[0].encode(), np.uint8)[at].copy()
            data[np.searchsorted(at, begin)] = value
            until = np.r_[at[1:], len(run[0])]
            data = data.tobytes()
            tried = 0
            for m in _STREAM.finditer(data):
                if m.start() < tried or at[m.start()] < taken or (got := _unpacked(data, m.start())) is None:
                    continue
                tried = m.start() + got[2]
                yield from _groups(layer, run.start(), begin, end, value, taken, int(at[m.start()]))
                taken = int(until[tried - 1])
                yield Piece(run.start() + int(at[m.start()]), run.start() + taken, got[0], kinds=got[1])
        yield from _groups(layer, run.start(), begin, end, value, taken, len(run[0]))


def _groups(layer: Layer, base: int, begin: np.ndarray, end: np.ndarray, value: np.ndarray, low: int, high: int) -> Iterator[Piece]:
    """Escapes side by side between two places of a run, as text."""
    a, b = np.searchsorted(begin, [low, high])
    if a == b:
        return
    cuts = [a, *(a + 1 + np.flatnonzero(begin[a + 1 : b] != end[a : b - 1])), b]
    for i, j in zip(cuts, cuts[1:], strict=False):
        start, stop = base + int(begin[i]), base + int(end[j - 1])
        if _touches(layer.fresh, start, stop):
            yield Piece(start, stop, *_by_bytes(value[i:j].astype(np.uint8).tobytes(), begin[i:j] - begin[i], end[i:j] - begin[i]))


def _escaped(layer: Layer) -> Iterator[Piece]:
    for m in _ESCAPES.finditer(layer.text):
        if not _touches(layer.fresh, m.start(), m.end()):
            continue
        units = [(int(u[1], 16), u.start(), u.end()) for u in _ESCAPE.finditer(m[0])]
        out, b, e, i = [], [], [], 0
        while i < len(units):
            value, begin, end = units[i]
            i += 1
            if 0xD800 <= value < 0xDC00 and i < len(units) and 0xDC00 <= units[i][0] < 0xE000:
                value, end = 0x10000 + (value - 0xD800 << 10) + units[i][0] - 0xDC00, units[i][2]
                i += 1
            out.append("\ufffd" if 0xD800 <= value < 0xE000 else chr(value))
            b.append(begin)
            e.append(end)
        yield Piece(m.start(), m.end(), "".join(out), np.array(b), np.array(e))


def _bytes64(body: str) -> bytes | None:
    body = body.translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _base64(run: str) -> Piece | None:
    """A run of base64 as text or as a stream."""
    body = run.rstrip("=")
    if (data := _bytes64(body)) is None:
        return None
    if (got := _unpacked(data)) is not None:
        return Piece(0, len(run), got[0], kinds=got[1])
    plain = data.decode("utf-8", "surrogateescape")
    if not plain.isprintable() and (inflated := _deflated(data)) is not None:
        return Piece(0, len(run), inflated[0], kinds=inflated[1])
    if not _readable(plain):
        return None
    k = np.arange(len(data))
    return Piece(0, len(run), *_by_bytes(data, k * 4 // 3, np.minimum(len(body), -(-(k + 1) * 4 // 3))))


def _promising(run: str, at: int) -> bool:
    """Whether the first bytes from a place on look like text or a stream."""
    some = run[at : at + 24].rstrip("=")
    data = _bytes64(some[: len(some) // 4 * 4]) if len(some) >= 16 else None
    return data is not None and (_unpacker(data[:10]) is not None or _readable(data.decode("utf-8", "surrogateescape")))


def _dense(layer: Layer) -> Iterator[Piece]:
    """Whole runs of base64 or hexadecimal digits."""
    for m in _BASE64.finditer(layer.text):
        if _touches(layer.fresh, m.start(), m.end()):
            piece = _base64(m[0])
            if _HEX.fullmatch(m[0]) and (got := _unpacked(bytes.fromhex(m[0]))) is not None:
                piece = Piece(0, len(m[0]), got[0], kinds=got[1])
            if piece is not None:
                yield piece._replace(start=m.start(), end=m.end())


def _behind(layer: Layer) -> Iterator[Piece]:
    """Base64 behind a name: as / - _ + are its digits too, what follows each of those is tried, to the run's end or to the next."""
    for m in _BASE64.finditer(layer.text):
        run = m[0]
        breaks = [k + 1 for k, c in enumerate(run) if c in "/-_+"]
        if not breaks or not _touches(layer.fresh, m.start(), m.end()):
            continue
        tried, done = set(), 0  # places alike modulo 4 have the same bytes behind them: one try to the run's end will do
        for at, stop in zip(breaks, [*(k - 1 for k in breaks[1:]), len(run)], strict=True):
            if at < done or not _promising(run, at):
                continue
            for until in ([stop] if at % 4 in tried or stop == len(run) else [len(run), stop]):
                if until - at >= 16 and (piece := _base64(run[at:until])) is not None:
                    yield piece._replace(start=m.start() + at, end=m.start() + until)
                    done = until
                    break
            tried.add(at % 4)


def _around(text: str, start: int, low: int) -> int:
    """Where the word around a place begins, or up to two words before it in the same line; not under `low`."""
    at = start
    while at > low and not text[at - 1].isspace():
        at -= 1
    for _ in range(2):
        gap = at
        while gap > low and text[gap - 1] != "\n" and text[gap - 1].isspace():
            gap -= 1
        if gap == at or gap == low or text[gap - 1] == "\n":
            break
        at = gap
        while at > low and not text[at - 1].isspace():
            at -= 1
    return at


def _child(parent: Layer, pieces: list[Piece]) -> Layer:
    """The pieces' texts in place, with the words around them; windows that don't meet are apart by a line break."""
    text = parent.text
    windows: list[tuple[int, int, list[Piece]]] = []
    word_end = hi = -1
    for piece in pieces:
        if piece.end > word_end:
            word_end, hi = _WORD.match(text, piece.end).end(), _AFTER.match(text, piece.end).end()
        low = windows[-1][1] if windows else 0
        lo = piece.start if windows and piece.start <= low else _around(text, piece.start, low)
        if windows and lo <= low:
            windows[-1] = (windows[-1][0], max(hi, low), windows[-1][2])
            windows[-1][2].append(piece)
        else:
            windows.append((lo, hi, [piece]))
    spot = np.arange(len(text), dtype=np.int64)
    begins, ends = (spot, spot + 1) if parent.begins is None else (parent.begins, parent.ends)
    out, b, e, fresh, size = [], [], [], [], 0
    for lo, hi, own in windows:
        at = lo
        for piece in own:
            out += [text[at : piece.start], piece.text]
            size += piece.start - at
            fresh.append((size, size + len(piece.text)))
            size += len(piece.text)
            b.append(begins[at : piece.start])
            e.append(ends[at : piece.start])
            if piece.begins is None:
                b.append(np.full(len(piece.text), begins[piece.start]))
                e.append(np.full(len(piece.text), ends[piece.end - 1]))
            else:
                b.append(begins[piece.start + piece.begins])
                e.append(ends[piece.start + piece.ends - 1])
            at = piece.end
        out += [text[at:hi], "\n"]
        b += [begins[at:hi], begins[hi - 1 : hi]]
        e += [ends[at:hi], ends[hi - 1 : hi]]
        size += hi - at + 1
    return Layer("".join(out), np.concatenate(b), np.concatenate(e), fresh)


def layers(text: str) -> Iterator[tuple[Layer, list[tuple[int, str, int]]]]:
    """The text's decoded layers, and findings (in the text's places) of streams that a layer holds only in part."""
    work = [Layer(text, None, None, [(0, len(text))])]
    seen: set[bytes] = set()
    while work:
        parent = work.pop()
        for codec, sign in ((_percent, "%"), (_escaped, "\\"), (_dense, ""), (_behind, "")):
            if sign not in parent.text or not (pieces := list(codec(parent))):
                continue
            child = _child(parent, pieces)
            key = hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16)
            key.update(child.begins.tobytes())
            key.update(child.ends.tobytes())
            key.update(repr(child.fresh).encode())
            if key.digest() in seen:
                continue
            seen.add(key.digest())
            at = (lambda k: k, lambda k: k + 1) if parent.begins is None else (lambda k: int(parent.begins[k]), lambda k: int(parent.ends[k]))
            work.append(child)
            yield child, [(at[0](p.start), kind, at[1](p.end - 1)) for p in pieces for kind in p.kinds]


def find(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Findings of the text itself and all findings, both sorted by start, then kind; spans are code points of the text."""
    base = sorted(scan(text), key=lambda f: (f[0], _ORDER[f[1]]))
    more = set(base)
    for layer, known in layers(text):
        more.update(known)
        more.update((int(layer.begins[s]), kind, int(layer.ends[t - 1])) for s, kind, t in scan(layer.text) if _touches(layer.fresh, s, t))
    return base, sorted(more, key=lambda f: (f[0], _ORDER[f[1]], f[2]))


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{t}" for s, kind, t in found)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and base_sha256 are of the text as it stands; spans adds what decoded layers show. Null texts count as empty,
    with counts of 0 and empty spans. Rows are independent, so repeated and null ids change nothing; other columns are not
    read, and an empty table gives no rows. Bare base64 and deflate streams without a head are taken for text if three quarters of
    its characters are readable; other layers have no such test. Work is in proportion to a text's length for each layer of nesting. Nothing is capped: streams that unpack to more than
    WINDOW bytes are unpacked and scanned in windows that share whole words, as their findings' places are the whole stream anyway; a
    window grows until it holds enough words, so that no encoded part is cut. xz streams get the memory that they ask for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            shas, spans = [], []
            for value in batch.column(1):
                base, everything = find(value.as_py() or "")
                for kind in KINDS:
                    counts[kind].append(sum(f[1] == kind for f in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(everything))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
