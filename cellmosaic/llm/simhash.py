"""SimHash near-duplicates: fingerprints linked at few differing bits, found by tables of distances to reference fingerprints.

Equal fingerprints are one class. Hamming distances of each class to many reference fingerprints are computed once. Two fingerprints
that differ in at most 3 bits have distances to every reference that differ by at most 3, so a pair is discarded by its maximum
coordinate difference, coordinate after coordinate, and only survivors are compared bit by bit.

Which pairs meet: of five blocks of bits, two at least are equal in linked fingerprints, so classes meet under each two blocks' bits. A
key that many classes have is dealt out by a salt, other for each key, and links within the salted groups join most of what belongs
together. Only where a key's classes are still in several components, they meet again under longer keys, and what is open
after that is compared in pairs of groups, with those outside the key's largest component on one side. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import components, cut, join_unique, seeded, text_buffer

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
WORDS, SEED, DISTANCE = 3, 42, 3
#: Blocks of bits in the first round of keys and in the round for what is still open; all but DISTANCE of them make a key.
ROUNDS = (5, 8)
#: Classes of a salted group, about.
GROUP = 1000
#: Reference fingerprints, made by rule.
REFERENCES = seeded(16, 31).view(np.int64).tolist()
#: Pairs that numpy holds at a time.
_PAIRS = 1 << 20


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if over half the hashes of its shingles, repeats included, have it."""
    found = raw.lower().split()  # of bytes: A-Z only, and at U+0020 and U+0009 to U+000D
    if not found:
        return 0
    joined, many = b" ".join(found), max(1, len(found) - words + 1)
    end = np.cumsum([len(w) + 1 for w in found]) - 1
    begin = np.r_[0, end[:-1] + 1]
    last = end[min(words, len(found)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, many, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin[k : min(k + (1 << 16), many)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > many).tolist()))


def _prints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            found = np.array([fingerprint(raw[a:b].tobytes(), words, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each document; fp as a signed long."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_prints(words, seed), "doc_id long, fp long")


def _masks(blocks: int) -> list[int]:
    """Bits of every choice of blocks that linked fingerprints may have in common."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [sum(1 << k for k in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(some) for some in combinations(each, blocks - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_distances(classes: DataFrame) -> DataFrame:
    """Adds the distances to the references, far."""
    return classes.withColumn("far", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("byte") for r in REFERENCES]))


def keyed(classes: DataFrame, blocks: int) -> DataFrame:
    """Classes (fp, far) under each of their keys (part, key)."""
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(_masks(blocks))])
    return classes.select("fp", "far", F.explode(keys).alias("k")).select("k.part", "k.key", "fp", "far")


def close_pairs(fp: np.ndarray, far: np.ndarray, most: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose fingerprints differ in at most so many bits: by the first distance those that are in reach, then by one distance after the other."""
    order = np.argsort(far[:, 0], kind="stable")
    reach = np.searchsorted(far[order, 0], far[order, 0] + most, "right")
    many = reach - np.arange(len(fp)) - 1
    total = np.r_[0, np.cumsum(many)]
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], many[lo:hi])
        i, j = order[i], order[j]
        for c in range(1, far.shape[1]):
            if not len(i):
                break
            kept = np.abs(far[i, c] - far[j, c]) <= most
            i, j = i[kept], j[kept]
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most
        yield i[near], j[near]
        lo = hi


def _stars(fp: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group as one link from each linked fingerprint to the first of those it is connected with."""
    i, j = (np.concatenate(x) for x in zip(*close_pairs(fp, far), strict=True))
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[some]], fp[some]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows (group, fp, far) that are sorted by group."""

    def links(group: np.ndarray, fp: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        found = [_stars(fp[a:b], far[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(REFERENCES)), np.int8))
    for batch in batches:
        own = (batch.column("group").to_numpy(), batch.column("fp").to_numpy(), batch.column("far").flatten().to_numpy().reshape(-1, len(REFERENCES)))
        group, fp, far = (np.concatenate(x) for x in zip(held, own, strict=True))
        if not len(group):
            continue
        last = int(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[-1])  # the last group may go on in the next batch
        if last:
            yield from links(group[:last], fp[:last], far[:last])
        held = (group[last:], fp[last:], far[last:])
    if len(held[0]):
        yield from links(*held)


def _links(rows: DataFrame, *group: str) -> DataFrame:
    """Links (a, b) within groups. Groups are told apart by a hash; two that it took for one would only add comparisons."""
    grouped = rows.select(F.xxhash64(*group).alias("group"), "fp", "far")
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_linked, "a long, b long")


def _merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is not None:
        links = links.unionByName(labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    return cut(components(links))


def _open(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Crowded keys' rows with their component, of keys whose classes are in several; outside is how many aren't in the largest."""
    now = cut(crowded.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    per = now.groupBy("part", "key", "component").agg(F.count("*").alias("m"))
    per = per.groupBy("part", "key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("k"), F.count("*").alias("several")).filter("several > 1")
    per = per.select("part", "key", "k", F.col("top.component").alias("largest"), (F.col("k") - F.col("top.m")).alias("outside"))
    return cut(join_unique(now.drop("k"), per, ["part", "key"], "k", now.count()))


def linked_classes(classes: DataFrame) -> DataFrame:
    """Components (node, component) of the classes' fingerprints (fp) that are linked; empty if none is."""
    members, labels = with_distances(classes), None
    slot = lambda n: F.pmod(F.xxhash64("fp", "part", "key"), n)
    groups = lambda n: F.ceil(n / GROUP)
    for blocks in ROUNDS:
        rows = cut(keyed(members, blocks))
        crowded = rows.groupBy("part", "key").agg(F.count("*").alias("k")).filter(F.col("k") > GROUP)
        rows = rows.join(crowded, ["part", "key"], "left")
        found = _links(rows.withColumn("salt", F.coalesce(slot(groups(F.col("k"))), F.lit(0).cast("long"))), "part", "key", "salt")
        labels = _merged(found, labels)
        now = _open(rows.filter("k IS NOT NULL"), labels)
        if now.isEmpty():
            return labels
        members = now.select("fp", "far").distinct()
    # each class outside the largest component meets all classes of its key: groups of the ones with groups of the others
    few, all_ = groups(F.col("outside")), groups(F.col("k"))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    out = now.filter("component <> largest").withColumn("one", slot(few)).withColumn("other", steps(all_))
    every = now.withColumn("one", steps(few)).withColumn("other", slot(all_))
    return _merged(_links(out.unionByName(every), "part", "key", "one", "other"), labels)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints are linked if they differ in at most three bits; component_id is the smallest doc_id reachable by links. Null texts,
    empty texts and texts without words have fingerprint zero, which is linked like any other. A null id is no candidate for
    component_id unless all ids reachable are null; repeated rows stay. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, doc_id, text))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    labels = linked_classes(classes.select("fp"))
    joined = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    linked, alone = joined.filter("component IS NOT NULL"), joined.filter("component IS NULL")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_unique(linked, least, ["component"], "members", labels.count()).select("fp", "copies", "component_id")
    named = cut(named.unionByName(alone.select("fp", "copies", F.col("least").alias("component_id"))))
    return join_unique(prints, named, ["fp"], "copies", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
