"""Exact deduplication by content-defined chunk recipes.

Each text, less its white space, is cut where a rolling hash of its last 32 bytes says so; chunks become identifiers and a
text becomes its recipe, the ordered list of identifiers. Whole texts are read and cut in place and never shuffled: what
moves is each distinct chunk once, to verify that an identifier stands for one chunk only, and the recipes. If two chunks
share an identifier, all identifiers are made anew with twice the bytes and verified again, so equal recipes mean equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import SPACE, code_points, cut, join_unique, row_blocks, seeded, text_buffer

#: Chunk sizes in bytes: fewest, mean (2 to this power, added to the fewest) and most.
FEWEST, MEAN_BITS, MOST = 256, 11, 16384
_GEAR = seeded(256, 3).astype(np.uint32)

_NAMES = {
    1: lambda x: xxhash.xxh3_64_digest(x)[:1],
    8: xxhash.xxh3_64_digest,
    16: xxhash.xxh3_128_digest,
    32: lambda x: hashlib.sha256(x).digest(),
}


def chunk_ends(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each row, where its chunks end. A cut depends on the 32 bytes before it and the cut before it, so equal texts are cut alike."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width) if width < len(h) else 0
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    lo = np.searchsorted(marks, at)
    out = []
    for r in range(len(at) - 1):
        last, stop, ends = int(at[r]), int(at[r + 1]), []
        for m in [*marks[lo[r] : lo[r + 1]].tolist(), stop]:
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= FEWEST or (m == stop and m > last):
                last = m
                ends.append(last)
        out.append(ends)
    return out


def squeezed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without white space."""
    keep = ~SPACE[raw]
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(keep, out=before[1:])
    return raw[keep], before[at]


def _recipes(width: int, id_column: str, text_column: str):
    name = _NAMES[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(text_column))
            shas, recipes, points = [], [], code_points(raw, at)
            for i, j in row_blocks(at):
                thin, cuts = squeezed(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                data = thin.tobytes()
                for r, ends in enumerate(chunk_ends(thin, cuts)):
                    first = int(cuts[r])
                    shas.append(hashlib.sha256(data[first : int(cuts[r + 1])]).hexdigest())
                    recipes.append(b"".join([name(data[a:b]) for a, b in zip([first, *ends], ends, strict=False)]))
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), batch.column("text_key"), pa.array(points, pa.int64()), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["doc_id", "text_key", "points", "text_sha256", "recipe"])

    return run


def _chunks(width: int, text_column: str):
    name = _NAMES[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(text_column))
            for i, j in row_blocks(at, 8 << 20):
                thin, cuts = squeezed(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                data, seen = thin.tobytes(), set()
                for r, ends in enumerate(chunk_ends(thin, cuts)):
                    seen.update(data[a:b] for a, b in zip([int(cuts[r]), *ends], ends, strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["chunk_id", "chunk"])

    return run


def clashes(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """Identifiers that stand for more than one distinct chunk of all texts."""
    distinct = docs.select(text).mapInArrow(_chunks(width, text), "chunk_id binary, chunk binary").groupBy("chunk_id", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")


def dedup_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_width: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key (a hash of the text as it is).

    Texts are equal when identical after deleting space and U+0009 to U+000D. Of equal texts the row with most code points,
    then smallest doc_id stays; of rows alike in both, one. Null texts count as empty, and all empty texts are one group;
    null ids come last. Other columns are not read. An empty table gives no rows. Hot groups are joined by broadcast of the few keys that hold over a
    thousandth of the rows each.
    """
    for width in [w for w in _NAMES if w >= first_width]:
        if width == 32 or clashes(docs, width, text).isEmpty():
            break
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    made = cut(rows.mapInArrow(_recipes(width, "doc_id", "text"), "doc_id long, text_key long, points long, text_sha256 string, recipe binary").withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")
    groups = made.groupBy("recipe").agg(best, F.count("*").alias("group_size")).select("recipe", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    groups = cut(groups)
    return join_unique(made, groups, ["recipe"], "group_size", made.count()).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "text_key")


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


#: DuckDB's regexp class [ \t-\r] is the same white space.
OP3_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
