"""Word shingles of whole texts as 64-bit hashes, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cellmosaic.llm.common import LOWER, row_blocks, seeded, span_hashes, splitmix, text_buffer, words

#: Words in a shingle.
WORDS = 5
_PLACE = seeded(WORDS, 21) | np.uint64(1)
_SHORT = seeded(WORDS + 1, 22)
_DIGEST = seeded(2, 23)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, one after the other, and where each text's begin (one more entry).

    ASCII letters count in lower case. A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    raw = LOWER[raw]
    begin, end, first = words(raw, at)
    hashed = span_hashes(raw, begin, end)
    many = np.maximum(len(hashed) - WORDS + 1, 0)
    rolled = np.zeros(many, dtype=np.uint64)
    for k in range(WORDS):
        rolled += hashed[k : k + many] * _PLACE[k]
    rolled = splitmix(rolled)
    out, sizes = [], np.zeros(len(at), dtype=np.int64)
    for r in range(len(at) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= WORDS:
            own = np.unique(rolled[a : b - WORDS + 1])
        elif b > a:
            own = splitmix((hashed[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a])
        else:
            continue
        out.append(own)
        sizes[r + 1] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)


def set_digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; equal sets have equal ones."""
    out = []
    for seed in _DIGEST:
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(splitmix(hashes ^ seed), out=total[1:])
        out.append(splitmix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


def blocks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, hashes and places of shingle sets, a few MB of text at a time."""
    raw, at = text_buffer(column)
    for i, j in row_blocks(at, limit):
        for lo in range(i, j, 60_000):  # rows of a block are numbered in 16 bits
            hi = min(j, lo + 60_000)
            yield (lo, hi, *shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
