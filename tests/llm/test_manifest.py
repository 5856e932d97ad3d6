"""The Merkle manifest, importance resampling and SimHash links against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellmosaic.llm import importance, merkle, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, index long, digest string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ------------------------------------------------------------------------------------------------------------


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = text.translate(LOWER) if lower and text is not None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for k, r in enumerate(groups[g]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded, proof = leaf(r, touched), ""
            for levels, at in ((trees[g], k), (top, place)):
                for level in levels[:-1]:
                    first = at // 8 * 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    proof, folded, at = proof + left + right, sha(left + folded + right), at // 8
            out.append((r[0], trees[g][0][k], trees[g][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r[:5], "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)


def document(k, lang, text):
    return (k, text, lang, "web" if k and k % 2 else None, None if k and k % 5 == 0 else 7)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "de": 65, "": 2}, {chr(97 + k): k + 1 for k in range(10)}, {"en": 4097, "fr": 3}])
def test_manifest(spark, sizes):
    rng = random.Random(1)
    rows = [document(rng.randrange(10**9), lang, "".join(rng.choices("abCDéÉ ", k=rng.randint(0, 30)))) for lang, n in sizes.items() for _ in range(n)]
    got, want = manifest(spark, rows), brute_manifest(rows)
    assert got == want and (len(rows) < 50 or {r[-1] for r in got} == {True, False})


def test_manifest_of_odd_rows(spark):
    long = "Word " * 50_000
    rows = [(None, None, None, None, None), (None, "A", "en", None, 3), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (3, "b", "en", "s", 1), (4, long, "en", "s", len(long)), (5, "ÄÖ", "é", "s", 2), (6, "x", "", "-", 1)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, []) == []


def test_sweeps_go_over_several_tables(spark, monkeypatch):
    """With blocks of 8^1 nodes each level is a table of its own."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [document(k, "en" if k % 3 else "de", "T%d" % k) for k in range(700)]
    known = merkle._passed_up([(16 + k, sha(str(k))) for k in range(3)], 1)
    assert known[1, 2] == sha("".join(sha(str(k)) for k in range(3)))
    nodes = merkle.ranked(merkle.leaf_digests(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)), ["doc_id", "leaf"])
    assert nodes.groupBy("grp").agg(F.max("index").alias("i"), F.first("n").alias("n"), F.countDistinct("index").alias("c")).filter("i + 1 = n AND c = n").count() == 2


# --- resampling ----------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute_resample(docs, target, percent=25, fewest=20):
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = Counter(bucket(f) for _, text in docs for f in runs(text)[1]), Counter(bucket(f) for text in target for f in runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for doc_id, text in docs:
        words, f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= fewest])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    n = percent * len(drawn) // 100
    rank = {id(r): k for k, r in enumerate(drawn[:n], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)] + ["Été", "ÜBER", "x.y", "日本", "a" * 100, "0"]
    return ["".join(w + rng.choice((" ", "\n", ", ", "--", "\t\t")) for w in rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(n)]


def resampled(spark, docs, target, parts=7, **options):
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in docs], "doc_id long, text string, score string, rank long").repartition(parts)
    return sorted((tuple(r) for r in importance.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()), key=str)


def test_resample(spark):
    docs = [(k * 7 % 503, t) for k, t in enumerate(texts(2, 500))]
    target = texts(3, 20)
    got = resampled(spark, docs, target)
    assert got == brute_resample(docs, target) and sum(r[4] is not None for r in got) > 50
    assert resampled(spark, docs, target, parts=1) == got


def test_resample_of_odd_rows(spark):
    long = "word " * 60_000 + "Q" * 100_000
    docs = [(1, None), (2, ""), (3, " \n"), (4, "x " * 30), (4, "x " * 30), (4, "x " * 30), (None, "y " * 30), (None, "y " * 30), (5, long), (6, "é" * 50), (7, "one two " * 20)]
    assert resampled(spark, docs, ["x y", None]) == brute_resample(docs, ["x y", None])
    assert resampled(spark, docs, []) == brute_resample(docs, [])
    assert resampled(spark, [], ["x"]) == []


def test_many_ties_are_dealt_out(spark):
    """Rows alike in score and id fall in several segments, and ranks stay exact."""
    rows = spark.createDataFrame([(7, 5, 0, 10)] * 4000 + [(k, 5, 0, k) for k in range(400)], "doc_id long, n_features long, weight long, score long").repartition(8)
    got = importance.ranked(rows, 100, picks=20).withColumn("part", F.spark_partition_id())
    found = got.collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 4401))
    assert [r["score"] for r in sorted(found, key=lambda r: r["rank"])] == sorted((r["score"] for r in found), reverse=True)
    assert max(Counter(r["part"] for r in found).values()) < 1500


def test_checksums_in_arrays():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 400)))) for _ in range(300)]
    raw, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    got = importance._checked(raw, end - [len(w) for w in words], end, np.full(300, importance._ONES)) ^ importance._ONES
    assert got.tolist() == [zlib.crc32(w) for w in words]


# --- SimHash -------------------------------------------------------------------------------------------------------------

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_labels(prints):
    """Smallest of the fingerprints reachable from each."""
    fp = np.unique(np.array(prints, dtype=np.uint64))
    label = np.arange(len(fp))
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 3) for x in fp]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(fp.tolist(), fp[label].tolist(), strict=True))
        label = new


def brute_near(rows):
    prints = [brute_print(t) for _, t in rows]
    label = brute_labels(prints) if rows else {}
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", least.get(label[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def near(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, key string").repartition(3)
    return sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)


def test_near_duplicates(spark):
    rng = random.Random(6)
    out = []
    for k in range(300):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(("Neu", "other", "word\n"))
            out.append((1000 - k, " ".join(w)))
        else:
            out.append((1000 - k, " ".join(rng.choices(["v%d" % j for j in range(500)], k=rng.randint(1, 300)))))
    got = near(spark, out)
    assert got == brute_near(out) and len({r[2] for r in got}) < 290


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (5, "One  two"), (None, "one\ttwo"), (None, "ünï " * 9), (7, "word " * 60_000), (8, "word " * 60_000 + "x"), (9, "é")]
    assert near(spark, rows) == brute_near(rows)
    assert near(spark, []) == []


@pytest.mark.parametrize("group", [8, 50])
def test_crowded_keys(spark, monkeypatch, group):
    """Dense balls, chains of links three bits apart, and codes whose words are just too far apart, far more than a group holds."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {0}
    for c in centres:
        for _ in range(250):
            x = c
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(30)
            prints.add(x)
    x = rng.getrandbits(64)
    for k in range(60):
        prints.add(x)
        x ^= 7 << rng.randrange(0, 60)
    prints |= {(k << 4 | (15 if k.bit_count() % 2 else 0)) ^ centres[0] >> 1 for k in range(200)}  # four bits apart at least
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = {r["node"] % 2**64: r["component"] % 2**64 for r in simhash.linked_classes(classes).collect()}
    want = brute_labels(list(prints))
    groups = lambda of: sorted(sorted(x for x in prints if of(x) == c) for c in {of(x) for x in prints})
    assert groups(lambda x: labels.get(x, x)) == groups(lambda x: want[x])


def test_pairs_within_reach():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 12, 400).astype(np.int64)
    far = np.stack([np.bitwise_count((fp ^ r).view(np.uint64)) for r in np.array(simhash.REFERENCES)], axis=1).astype(np.int8)
    got = {tuple(sorted(p)) for i, j in simhash.close_pairs(fp, far) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400) if int(fp[a] ^ fp[b]).bit_count() <= 3}
