"""Helpers that several training-data operators share: scratch tables, byte kernels over Arrow text, joins on hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII letters folded to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset, a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs start from these files, also after losing executors."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit integers, made by rule from a seed."""
    return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; nulls are empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def row_blocks(at: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes together, or one longer row: numpy's work arrays stay small."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in raw, and for each row the place of its first word (one more entry than rows)."""
    inside = ~between[raw]
    begin, end = inside.copy(), inside.copy()
    if len(raw):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(end) + 1, np.searchsorted(b, at)


_BYTE_CODE = seeded(256, 7)
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans raw[begin:end], from one running polynomial sum."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    return splitmix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def gram_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each n consecutive of the given ones, from one running polynomial sum."""
    many = len(hashed)
    if many < n:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(many + 1)
    total = np.zeros(many + 1, dtype=np.uint64)
    np.cumsum(hashed * up[:many], out=total[1:])
    return splitmix((total[n:] - total[:-n]) * down[: many - n + 1])


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    heads = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return np.diff(heads[at])


def join_unique(left: DataFrame, right: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join with a right side that has one row a key and, in `size`, how many left rows carry it.

    Keys held by over a thousandth of all `total` rows are at most a thousand by counting, so only those are broadcast;
    the rest are joined by shuffle and none of them is hot.
    """
    limit = max(1000, total // 1000)
    hot, even = F.broadcast(right.filter(F.col(size) > limit)), right.filter(F.col(size) <= limit)
    return left.join(hot, key).unionByName(left.join(hot.select(*key), key, "left_anti").join(even, key))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: each node beside the smallest it is connected with in this partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, component), component the smallest node reachable.

    Each partition's edges are first reduced to stars; then large-star and small-star steps alternate until nothing changes. A
    step is two shuffled aggregations over the edges; labels stay distributed and each step's edges are written to the shared
    folder. Empty edges give no rows.
    """
    columns = ["u long", "v long"]
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").mapInArrow(_contracted, ", ".join(columns))
    before = None
    while True:
        seen = Observation()
        now = cut(now.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")))
        after = (seen.get["n"], seen.get["h"])
        if after == before or not after[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before = after
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.col("m").alias("u"), F.col("v").alias("v")).union(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
        now = step.filter("u <> v").distinct()
