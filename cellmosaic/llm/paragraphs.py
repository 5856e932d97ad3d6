"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard checks, clusters by components.

Paragraphs are lines, and passages that join consecutive short lines, so that text broken into short lines is seen. Those with equal shingle sets are one class. Each class has a MinHash signature cut into bands, as many as
the wanted recall takes; classes that collide in a band are compared by the exact Jaccard similarity of their shingle sets, and
linked classes form clusters. Of a cluster the first paragraph stays and the others are to be removed, if they are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm import runs, shingles
from cellmosaic.llm.common import code_points, cut, join_unique, row_blocks, seeded, splitmix, text_buffer, words
from cellmosaic.llm.ngram_join import PERCENT, bitmap, linked_classes

#: Shorter paragraphs are common phrases rather than repeated passages: op2 reports them, but they are not to be removed.
LEAST_WORDS = 20
#: Runs of so many words that occur again are found wherever lines begin and end.
RUN_WORDS = 45
#: Wanted recall at the threshold, and most chance that a pair of similarity UNLIKE collides.
RECALL, UNLIKE, CHANCE = 0.999, 0.2, 0.15
#: Band entries that one task of a fragment should hold about.
FRAGMENT = 1_000_000


def tuned_bands(similarity: float, recall: float = RECALL, unlike: float = UNLIKE, chance: float = CHANCE) -> tuple[int, int]:
    """Bands and rows a band: the fewest hashes that reach the recall and keep unlike pairs apart."""
    best = None
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - unlike**rows) ** bands <= chance and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best


def lines(raw: np.ndarray, at: np.ndarray, least: int, passage: int = 0) -> tuple[np.ndarray, ...]:
    """Begin and end of each line of at least that many words, its row, its number in the row, how many lines it is, and its words.

    With a passage length, lines of fewer words are joined too: from each of them on, as few following ones as reach that length,
    over empty lines but not over longer ones.
    """
    breaks = np.flatnonzero(raw == 10)
    begin = np.union1d(at[:-1][np.diff(at) > 0], breaks + 1)
    begin = begin[begin < len(raw)]
    row = np.searchsorted(at, begin, "right") - 1
    after = np.r_[begin[1:], len(raw)]
    end = np.where((after > 0) & (raw[np.maximum(after - 1, 0)] == 10), after - 1, after) if len(begin) else after[:0]
    number = np.arange(len(begin)) - np.searchsorted(row, row)
    word, _, _ = words(raw, at)
    many = np.searchsorted(word, end) - np.searchsorted(word, begin)
    one = np.flatnonzero(many >= least)
    first, last = one, one
    some = np.flatnonzero(many > 0)
    if passage and len(some):
        long, own = many[some] >= passage, row[some]
        run = np.cumsum(long | np.r_[True, (own[1:] != own[:-1]) | long[:-1]])
        total = np.r_[0, np.cumsum(many[some])]
        until = np.searchsorted(total, total[:-1] + passage) - 1
        whole = np.flatnonzero(~long & (until < len(some)) & (run[np.minimum(until, len(some) - 1)] == run))
        first, last = np.r_[first, some[whole]], np.r_[last, some[until[whole]]]
    size = np.searchsorted(word, end[last]) - np.searchsorted(word, begin[first])
    return begin[first], end[last], row[first], number[first], number[last] - number[first] + 1, size


def _sets(column: pa.Array, least: int, passage: int):
    """For some rows at a time: paragraphs (row, number, lines, words, begin, end in code points) and their shingle sets."""
    raw, at = text_buffer(column)
    for i, j in row_blocks(at):
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        begin, end, row, number, joined, size = lines(part, cuts, least, passage)
        if not len(begin):
            continue
        # the paragraphs' bytes side by side
        taken = end - begin
        place = np.r_[0, np.cumsum(taken)]
        picked = part[np.repeat(begin - place[:-1], taken) + np.arange(place[-1])]
        hashes, own = shingles.shingle_sets(picked, place)
        heads = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=heads[1:])
        yield i + row, number, joined, size, heads[begin] - heads[cuts[row]], heads[end] - heads[cuts[row]], hashes, own


def _list(least: int, passage: int, removed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, joined, size, begin, end, hashes, own in _sets(batch.column(2), least, passage):
                a, _ = shingles.set_digests(hashes, own)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(take) for k in (0, 1, 3)), pa.array(number), pa.array(joined), pa.array(begin), pa.array(end - begin), pa.array(size >= removed), pa.array(np.diff(own)), pa.array(a.view(np.int64))],
                    ["doc_id", "text_key", "document", "paragraph", "lines", "start", "length", "removable", "n", "node"],
                )

    return run


def band_keys(hashes: np.ndarray, own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each set."""
    keys = np.zeros((len(own) - 1, bands), dtype=np.uint64)
    for k, seed in enumerate(seeded(bands * rows, 31)):
        least = np.minimum.reduceat((hashes ^ seed) * (seed | np.uint64(1)), own[:-1])
        keys[:, k // rows] = splitmix(keys[:, k // rows] + least + np.uint64(k))
    return keys


def _banded(fragments: int, least: int, passage: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for *_, hashes, own in _sets(batch.column(0), least, passage):
                nodes = shingles.set_digests(hashes, own)[0].view(np.int64)
                new = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], dtype=bool)
                keys = band_keys(hashes, own, bands, rows)[new]
                flat, who = keys.ravel(), np.repeat(nodes[new], bands)
                part = (flat % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(fragments + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array([flat[order[edges[f] : edges[f + 1]]].tobytes() for f in some], pa.binary()), pa.array([who[order[edges[f] : edges[f + 1]]].tobytes() for f in some], pa.binary())],
                    ["fragment", "bands", "nodes"],
                )

    return run


def _collisions(table: pa.Table) -> pa.Table:
    """Entries of bands in which more than one class is."""
    read = lambda c: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.int64)
    bands, nodes = read("bands"), read("nodes")
    order = np.lexsort((nodes, bands))
    bands, nodes = bands[order], nodes[order]
    fresh = np.ones(len(bands), dtype=bool)
    fresh[1:] = (bands[1:] != bands[:-1]) | (nodes[1:] != nodes[:-1])
    bands, nodes = bands[fresh], nodes[fresh]
    begin = np.flatnonzero(np.r_[True, bands[1:] != bands[:-1]]) if len(bands) else np.zeros(0, np.int64)
    many = np.diff(np.r_[begin, len(bands)])
    keep = np.repeat(many, many) > 1
    return pa.table({"token": pa.array(bands[keep]), "node": pa.array(nodes[keep])})


def _tokens(least: int, passage: int):
    """The sets of the classes that are asked for beside each text, and no others, since a text may have many more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            left = set(zip(np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False)).tolist(), asked.flatten().to_pylist(), strict=True))
            for row, *_, hashes, own in _sets(batch.column(0), least, passage):
                nodes = shingles.set_digests(hashes, own)[0].view(np.int64)
                new = [k for k, x in enumerate(zip(row.tolist(), nodes.tolist(), strict=True)) if x in left and not left.discard(x)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(np.diff(own)[new]), pa.array([hashes[own[k] : own[k + 1]].view(np.int64) for k in new], pa.list_(pa.int64())), pa.array([bitmap(hashes[own[k] : own[k + 1]]) for k in new], pa.binary())], ["node", "n", "tokens", "bits"])

    return run


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, passage_words: int = 0, removed_words: int = 0, run_words: int = 0) -> DataFrame:
    """One row per paragraph that occurs more than once: doc_id, paragraph, lines, start, length, cluster_id, copies, keep_doc_id, removed, run, text_key.

    Paragraphs are lines of at least least_words words, start and length their place in code points; near copies have a
    Jaccard similarity of 5-word shingles of percent / 100 or more. cluster_id is shared by all paragraphs reachable through
    near copies, copies is their number; the one of smallest doc_id, then paragraph stays. With passage_words, each line of
    fewer words also begins a paragraph of several lines, as few as have so many words together. Such paragraphs overlap:
    each counts in copies, but a cluster has two that don't overlap, and none is removed that shares a line with the one that
    stays. Paragraphs of under removed_words words are not removed. With run_words, runs of words that occur again wherever lines
    begin and end have rows of their own, in which run is true (see runs.repeated_runs). Null and empty texts have no
    paragraphs; null ids come last; of rows alike in id and text one keeps its paragraphs. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = cut(rows.select("doc_id", "text_key", "text", F.monotonically_increasing_id()).mapInArrow(_list(least_words, passage_words, removed_words), "doc_id long, text_key long, document long, paragraph long, lines long, start long, length long, removable boolean, n long, node long").withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "paragraph", "row", "text_key", "document", "lines")).alias("first")
    # paragraphs of several documents, or of several places in one, are apart
    extent = {"d0": F.min("document"), "d1": F.max("document"), "ends": F.min(F.col("paragraph") + F.col("lines")), "begins": F.max("paragraph")}
    classes = cut(found.groupBy("node", "n").agg(first, F.count("*").alias("copies"), *[v.alias(k) for k, v in extent.items()]))
    bands, per_band = tuned_bands(percent / 100)
    fragments = max(8, classes.count() * bands // FRAGMENT)
    entries = rows.select("text").mapInArrow(_banded(fragments, least_words, passage_words, bands, per_band), "fragment long, bands binary, nodes binary").groupBy("fragment").applyInArrow(_collisions, "token long, node long")
    entries = cut(entries.join(classes.select("node", "n"), "node"))
    nodes = entries.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").groupBy(F.col("first.doc_id").alias("rep_id"), F.col("first.text_key").alias("rep_key")).agg(F.collect_list("node").alias("asked"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.rep_id")) & (F.col("d.text_key") == F.col("m.rep_key"))
    sets = rows.alias("d").join(wanted.alias("m"), same).select("text", "asked").mapInArrow(_tokens(least_words, passage_words), "node long, n long, tokens array<long>, bits binary")
    sets = cut(sets.groupBy("node", "n").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")).withColumn("have", F.transform("tokens", lambda x: F.lit(0))).withColumn("alone", F.lit(0).cast("long")))
    labels = linked_classes(sets, percent, entries)
    named = classes.withColumn("component", F.col("node")) if labels is None else classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    clusters = named.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("all_copies"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("ends").alias("ends"), F.max("begins").alias("begins"))
    clusters = clusters.filter("all_copies > 1 and (d0 <> d1 or begins >= ends)").select("component", "first", "all_copies")
    placed = cut(named.select("node", "n", "copies", "component").join(clusters, "component"))
    full = join_unique(found, placed, ["node", "n"], "copies", found.count())
    beside = (F.col("document") != F.col("first.document")) | (F.col("paragraph") >= F.col("first.paragraph") + F.col("first.lines"))
    out = full.select("doc_id", "paragraph", "lines", "start", "length", F.col("component").alias("cluster_id"), F.col("all_copies").alias("copies"), F.col("first.doc_id").alias("keep_doc_id"), (F.col("removable") & beside & (F.col("row") != F.col("first.row"))).alias("removed"), F.lit(False).alias("run"), "text_key")
    if not run_words:
        return out
    characters = found.filter("lines = 1").agg(F.sum("length")).first()[0] or 0
    again = runs.repeated_runs(rows.withColumn("document", F.monotonically_increasing_id()), run_words, max(removed_words, LEAST_WORDS), characters)
    return out.unionByName(again.withColumn("run", F.lit(True)))


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Documents less their removed paragraphs and runs, other lines as they are; n_chars is made anew if there is such a column.

    Removed paragraphs go with their lines. Of a removed run the words go, and lines of which nothing is left.
    """
    key = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    numbers = F.when(~F.col("run"), F.sequence("paragraph", F.expr("paragraph + lines - 1")))
    span = F.when(F.col("run"), F.struct("start", "length"))
    gone = repeats.filter("removed").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(numbers))).alias("_gone"), F.array_sort(F.collect_set(span)).alias("_runs"))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    # the text between runs, and of runs their line breaks, so that lines keep their numbers
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def past(done, one):
        end = F.greatest(done["at"], one["start"] + one["length"])
        piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        here = F.greatest(done["at"], one["start"])
        return F.struct(end.alias("at"), F.concat(done["text"], piece(done["at"], here), F.regexp_replace(piece(here, end), "[^\n]+", "")).alias("text"))

    rest = F.aggregate("_runs", start, past, lambda done: F.concat(done["text"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))))
    lines_ = F.arrays_zip(F.split("text", "\n").alias("was"), F.split(rest, "\n").alias("now"))
    left = F.filter(lines_, lambda x, i: ~F.array_contains("_gone", i.cast("long")) & ((x["was"] == x["now"]) | (F.trim(x["now"]) != "")))
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda x: x["now"]), "\n"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_paragraphs(docs, least_words=1, passage_words=LEAST_WORDS, removed_words=LEAST_WORDS, run_words=RUN_WORDS).drop("text_key")
