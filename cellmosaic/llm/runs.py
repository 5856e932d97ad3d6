"""Runs of words that occur again anywhere in the documents, wherever lines begin and end.

Winnowing: of each window of consecutive word n-grams those of least hash are anchors, so two runs that hold the same window of words
have an anchor in common. Anchors meet by hash in fragments; those of one document that touch, or
repeat the same place in steps of a window at most, are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import LOWER, gram_hashes, row_blocks, span_hashes, text_buffer, words

#: Anchors that one task of a fragment should hold about.
FRAGMENT = 1_000_000
#: An anchor: hash, place of its document in the row, word, start and length in code points, line, lines.
_ANCHOR = np.dtype([("h", "u8"), ("doc", "u4"), ("word", "u4"), ("start", "u4"), ("length", "u4"), ("line", "u4"), ("lines", "u4")])
_PLACED = "h long, doc_id long, text_key long, document long, word long, start long, length long, paragraph long, lines long, copies long, keep_doc_id long, keep_document long, keep_word long"


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def anchors(raw: np.ndarray, at: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Anchors of each text: of every `window` consecutive word n-grams inside it, all that have the least hash."""
    begin, end, first = words(raw, at)
    many = len(begin)
    if many < gram + window - 1:
        return np.zeros(0, _ANCHOR)
    grams = gram_hashes(span_hashes(LOWER[raw], begin, end), gram)
    own = np.repeat(np.arange(len(at) - 1), np.diff(first))
    least = np.where(own[: len(grams) - window + 1] == own[gram + window - 2 :], _sliding(grams, window, np.minimum), np.uint64(0))
    beside = np.zeros(window - 1, np.uint64)
    word = np.flatnonzero((_sliding(np.r_[beside, least, beside], window, np.maximum) == grams) & (grams > 0))
    last, row = word + gram - 1, own[word]
    heads = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, begin[word])
    out = np.zeros(len(word), _ANCHOR)
    out["h"], out["doc"], out["word"] = grams[word], row, word - first[row]
    out["start"], out["length"] = heads[begin[word]] - heads[at[row]], heads[end[last]] - heads[begin[word]]
    out["line"], out["lines"] = line - np.searchsorted(breaks, at[row]), np.searchsorted(breaks, begin[last]) - line + 1
    return out


def _dealt(fragments: int, gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(3))
            for i, j in row_blocks(at):
                found = anchors(raw[at[i] : at[j]], at[i : j + 1] - at[i], gram, window)
                part = (found["h"] % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(fragments + 1))
                some, packs, docs = np.flatnonzero(np.diff(edges)), [], []
                for f in some:
                    own = found[order[edges[f] : edges[f + 1]]]
                    ids, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    packs.append(own.tobytes())
                    docs.append(i + ids.astype(np.int64))
                sizes = np.r_[0, np.cumsum([len(x) for x in docs])].astype(np.int32)
                take = pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(sizes), batch.column(k).take(take)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packs, pa.binary()), *lists], ["fragment", "anchors", "ids", "keys", "documents"])

    return run


def _again(gram: int):
    """Of a fragment, the anchors that occur in several documents or at places apart in one, each with the first of its kind."""

    def run(table: pa.Table) -> pa.Table:
        packs = [np.frombuffer(x.as_py(), _ANCHOR) for x in table.column("anchors")]
        found = np.concatenate(packs) if packs else np.zeros(0, _ANCHOR)
        flat = lambda c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks])
        ids, keys, documents = (flat(c) for c in ("ids", "keys", "documents"))
        before = np.r_[0, np.cumsum(table.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))][:-1]
        doc = found["doc"].astype(np.int64) + np.repeat(before.astype(np.int64), [len(x) for x in packs])
        null, number, document = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), documents.to_numpy()
        order = np.lexsort((found["word"], document[doc], number[doc], null[doc], found["h"]))
        found, doc = found[order], doc[order]
        begin = np.flatnonzero(np.r_[True, found["h"][1:] != found["h"][:-1]])
        many = np.diff(np.r_[begin, len(found)])
        first = np.repeat(begin, many)
        apart = (document[doc] != document[doc[first]]) | (found["word"] >= found["word"][first] + gram)
        kept = np.flatnonzero(np.repeat(np.logical_or.reduceat(apart, begin), many))
        own, one = doc[kept], doc[first[kept]]
        wide = lambda c, at: pa.array(found[c][at].astype(np.int64))
        columns = [pa.array(found["h"][kept].view(np.int64)), ids.take(pa.array(own)), keys.take(pa.array(own)), documents.take(pa.array(own)), *(wide(c, kept) for c in ("word", "start", "length", "line", "lines"))]
        columns += [pa.array(np.repeat(many, many)[kept]), ids.take(pa.array(one)), documents.take(pa.array(one)), wide("word", first[kept])]
        return pa.table(columns, names=[c.split(" ")[0] for c in _PLACED.split(", ")])

    return run


def repeated_runs(docs: DataFrame, run_words: int, gram: int, characters: int) -> DataFrame:
    """Runs of words that occur more than once in docs (doc_id, text_key, document, text), in the columns of repeated paragraphs.

    Of any run_words consecutive words that occur at two places, a part of at least `gram` words is reported at both; what is
    reported occurs elsewhere in full up to the words between its anchors. ASCII letters count in lower case, white space alike.
    `start` and `length` are the run's, paragraph and lines the lines that it touches; cluster_id and copies are of its first
    anchor, whose first occurrence, by doc_id and place, stays. `characters` is about how many code points there are.
    """
    window = run_words - gram + 1
    fragments = max(8, characters // 3 // (window + 1) // FRAGMENT)
    dealt = docs.select("doc_id", "text_key", "document", "text").mapInArrow(_dealt(fragments, gram, window), "fragment long, anchors binary, ids array<long>, keys array<long>, documents array<long>")
    placed = dealt.groupBy("fragment").applyInArrow(_again(gram), _PLACED).withColumn("ahead", F.col("word") - F.col("keep_word"))
    # an anchor that overlaps the one that stays is left; others of a document are put together where they touch or go on alike
    placed = placed.withColumn("removed", (F.col("document") != F.col("keep_document")) | (F.col("ahead") >= gram))
    inside = Window.partitionBy("document", "removed").orderBy("word")
    gap, alike = F.col("word") - F.lag("word").over(inside), (F.lag("keep_document").over(inside) == F.col("keep_document")) & (F.lag("ahead").over(inside) == F.col("ahead"))
    steps = placed.withColumn("step", F.coalesce(F.sum((gap > F.when(alike, max(gram, window)).otherwise(gram)).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    least = F.min("start")
    runs = steps.groupBy("document", "removed", "step").agg(
        F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.min_by("keep_doc_id", "word").alias("keep_doc_id"), F.min("paragraph").alias("paragraph"), (F.max(F.col("paragraph") + F.col("lines")) - F.min("paragraph")).alias("lines"),
        least.alias("start"), (F.max(F.col("start") + F.col("length")) - least).alias("length"), F.min_by("h", "word").alias("cluster_id"), F.min_by("copies", "word").alias("copies"),
    )
    return runs.select("doc_id", "paragraph", "lines", "start", "length", "cluster_id", "copies", "keep_doc_id", "removed", "text_key")
