"""Importance resampling towards a target distribution of hashed word n-grams, drawn by parallel sorting by regular sampling.

Features of all documents and of the target's texts are counted in buckets; the logarithm of the two frequencies' quotient is a
bucket's gain, and a document's weight the mean of its features' gains. Weights of a batch of documents are taken from arrays. Gumbel
noise makes the highest scores a draw without replacement in proportion to the weights. For exact ranks, each run of scores is
sorted where it lies; as many scores from each, at regular steps, give the splitters; each segment between splitters is exchanged to one
task, which merges what it gets; and counts of the segments before say where its ranks begin.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellmosaic.llm.common import LOWER, cut, row_blocks, text_buffer, words

#: Buckets of features, words that a document needs to be drawn, hundredths that are drawn, and the seed of the noise.
BUCKETS, FEWEST, PERCENT, SEED = 10_000, 20, 25, 7
#: Sorted runs at most, and scores that each gives at most for splitters: the driver sorts no more than their product, whatever the corpus.
RUNS, PICKS = 2000, 100

#: Bytes outside words: all of ASCII but digits and small letters.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ONES = np.uint32(0xFFFFFFFF)
#: Bytes of a word that are taken for all words at once; the rest of a longer word follows on its own.
_SHORT = 64


def _checked(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of CRC-32 after the bytes raw[begin:end], each from a state before."""
    order = np.argsort(begin - end, kind="stable")  # longest first, so that spans with a k-th byte are the first ones
    b, e, s = begin[order], end[order], state[order]
    shorter = b - e
    for k in range(min(int(-shorter.min(initial=0)), _SHORT)):
        m = int(np.searchsorted(shorter, -k, "left"))
        s[:m] = _CRC[(s[:m] ^ raw[b[:m] + k]) & np.uint32(255)] ^ s[:m] >> np.uint32(8)
    for k in range(int(np.searchsorted(shorter, -_SHORT, "left"))):
        s[k] = zlib.crc32(raw[b[k] + _SHORT : e[k]].tobytes(), int(s[k] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and row after the last of some texts, place of each row's first word, buckets of words and of pairs of words, and which pairs lie in one text."""
    raw, at = text_buffer(column)
    for i, j in row_blocks(at):
        own, rows = LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
        begin, end, first = words(own, rows, _OUTSIDE)
        one = _checked(own, begin, end, np.full(len(begin), _ONES))
        inner = np.ones(max(0, len(begin) - 1), dtype=bool)
        last = first[1:-1] - 1
        inner[last[(last >= 0) & (last < len(inner))]] = False
        spaced = _CRC[(one[:-1] ^ np.uint32(0x20)) & np.uint32(255)] ^ one[:-1] >> np.uint32(8)
        two = _checked(own, begin[1:], end[1:], spaced)
        yield i, j, first, (one ^ _ONES) % np.uint32(buckets), (two ^ _ONES) % np.uint32(buckets), inner


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, one, two, inner in features(batch.column(0), buckets):
                total += np.bincount(one, minlength=buckets) + np.bincount(two[inner], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends one row a bucket."""
    return texts.select(F.col(text).cast("string")).mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from (bucket, n) of source and target: as many numbers as there are buckets, whatever the corpus."""
    counts = []
    for df in (source, target):
        n = np.zeros(buckets, dtype=np.int64)
        for row in df.collect():
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * total_s / ((float(a) + 1) * total_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document in thousandths; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, fewest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, drawn = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for i, j, first, one, two, inner in features(batch.column(1), len(gain)):
                sums = np.zeros(len(one) + 1, dtype=np.int64)
                np.cumsum(gain[one], out=sums[1:])
                pairs = np.zeros(len(two) + 1, dtype=np.int64)
                np.cumsum(np.where(inner, gain[two], 0), out=pairs[1:])
                many = np.diff(first)
                n[i:j] = many + np.maximum(many - 1, 0)
                a, b = np.minimum(first, len(two)), np.maximum(first[1:] - 1, first[:-1])
                total = sums[first[1:]] - sums[first[:-1]] + pairs[np.minimum(b, len(two))] - pairs[a[:-1]]
                weight[i:j] = np.where(n[i:j] > 0, total // np.maximum(n[i:j], 1), 0)
                drawn[i:j] = many >= fewest
            luck = np.array([noise(x, seed) for x in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + luck), pa.array(drawn.astype(bool))], ["doc_id", "n_features", "weight", "score", "eligible"])

    return run


def scores(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", fewest: int = FEWEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of each document."""
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(_scored(gain, fewest, seed), "doc_id long, n_features long, weight long, score long, eligible boolean")


_ROW = "doc_id long, n_features long, weight long, score long"
_NAMES = ["doc_id", "n_features", "weight", "score"]
_LEAST = -(1 << 63)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES), pa.array(np.full(n, run)), pa.array(np.arange(place, place + n))], [*_NAMES, "run", "place"])
        place += n


def _keys(batch) -> tuple[np.ndarray, ...]:
    """What rows are ordered by: descending score, ascending id (null first), run and place."""
    ids = batch.column("doc_id").fill_null(_LEAST)
    return -batch.column("score").to_numpy(), ids.to_numpy(), batch.column("run").to_numpy(), batch.column("place").to_numpy()


def _segment_of(splitters: list[tuple[int, int, int, int]]):
    """Segment of each row: how many splitters are before it or it."""
    first = np.array([s[0] for s in splitters], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            low, high = np.searchsorted(first, keys[0], "left"), np.searchsorted(first, keys[0], "right")
            for k in np.flatnonzero(low < high):  # as high as some splitter: the other keys decide
                low[k] = bisect_left(splitters, tuple(int(x[k]) for x in keys), int(low[k]), int(high[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], [*batch.schema.names, "segment"])

    return run


def _ranks(before: dict[int, int], drawn: int):
    """Ranks of merged segments, counted on from what is in the segments before; beyond the drawn ones null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            rank = np.empty(len(segment), dtype=np.int64)
            edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(segment) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if segment[a] != now:
                    now, at = int(segment[a]), before[int(segment[a])]
                rank[a:b] = np.arange(at + 1, at + 1 + b - a)
                at += int(b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES), pa.array(rank, mask=rank > drawn)], [*_NAMES, "rank"])

    return run


def ranked(rows: DataFrame, percent: int = PERCENT, most_runs: int = RUNS, picks: int = PICKS) -> DataFrame:
    """Rows (doc_id, n_features, weight, score) with rank 1, 2, 3... of the highest percent of scores, ties to the smaller id.

    Rows alike in score and id are told apart by their place in the runs, so that no number of them makes a segment large.
    """
    seen = Observation()
    runs = rows.coalesce(most_runs).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id")).mapInArrow(_placed, f"{_ROW}, run long, place long")
    runs = cut(runs.observe(seen, F.count("*").alias("n")))
    total = seen.get["n"]
    sizes = runs.groupBy("run").agg(F.count("*").alias("k"))  # a row a run
    regular = runs.join(F.broadcast(sizes), "run").filter(F.col("place") % F.ceil(F.col("k") / picks) == 0).select("doc_id", "score", "run", "place").toArrow()
    found = sorted(zip(*(k.tolist() for k in _keys(regular.combine_chunks())), strict=True))
    many = len(set(regular.column("run").to_pylist()))
    splitters = [found[len(found) * k // many] for k in range(1, many)]
    dealt = runs.mapInArrow(_segment_of(splitters), f"{_ROW}, run long, place long, segment long")
    before, at = {}, 0
    for segment, k in sorted(tuple(r) for r in dealt.groupBy("segment").agg(F.count("*")).collect()):  # a row a segment
        before[segment], at = at, at + k
    merged = dealt.repartitionById(max(many, 1), F.col("segment").cast("int")).sortWithinPartitions("segment", F.desc("score"), F.asc_nulls_first("doc_id"), "run", "place")
    return merged.mapInArrow(_ranks(before, percent * total // 100), f"{_ROW}, rank long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, fewest: int = FEWEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank, 1 for the best of the documents drawn and null for others.

    Of the documents with at least `fewest` words, percent hundredths (rounded down) are drawn. Null and empty texts have no
    features and weight 0; a null id is drawn like another, and comes first among ties. An empty target makes rare features gain; an empty table
    gives no rows.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets), buckets)
    scored = cut(scores(docs, gain, doc_id, text, fewest, seed))
    rest = scored.filter("NOT eligible").select(*_NAMES, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.filter("eligible").select(*_NAMES), percent).unionByName(rest)


def op12(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""WITH bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT kind, id, len(w) AS words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS x FROM w),
n AS (SELECT x, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f GROUP BY x),
h AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(x)), lambda k: CAST('0x' || substr(hex(x), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(tab.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM n, tab),
g AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM h GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
gain AS (SELECT bucket, CAST(floor(1000 * ln((g.t + 1) * (z.s + {BUCKETS}) / ((g.s + 1) * (z.t + {BUCKETS})))) AS BIGINT) AS gain FROM g, z),
d AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN h USING (x) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
a AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total / n_features) AS BIGINT), 0) AS weight FROM w LEFT JOIN d USING (id) WHERE kind = 0),
b AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM b WHERE words >= {FEWEST})
SELECT b.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM b LEFT JOIN r USING (doc_id)"""
