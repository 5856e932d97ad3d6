"""Operators over documents against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.llm import common, exact_dedup, fingerprints, mixing, ngram_join, packing, paragraphs, quality, secrets

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=4, n=120):
    """Texts with exact copies, near copies of several degrees and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(300)] + ["Été", "ÜBER", "x.y"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.3 or not texts:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        elif kind < 0.85:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=40)) + "\n" + passage)
    return [(1000 - k, t, "s%d" % (k % 4)) for k, t in enumerate(texts)]


def brute_components(sets, percent=75):
    ids = list(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_exact_dedup(table):
    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.dedup_exact(table(rows)).collect()}
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    for thin, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(members)[1], len(members), i == min(members)[1])
            assert r["text_sha256"] == hashlib.sha256(thin.encode()).hexdigest()


def test_exact_dedup_verifies_identifiers(table):
    """With identifiers of one byte chunks clash, and wider ones are taken."""
    rows = corpus(9)
    assert not exact_dedup.clashes(table(rows), 1).isEmpty()
    one, two = ({(r["doc_id"], r["keep_id"]) for r in exact_dedup.dedup_exact(table(rows), first_width=w).collect()} for w in (1, 8))
    assert one == two


def test_chunks_follow_content():
    data = np.frombuffer(random.Random(2).randbytes(90_000), np.uint8)
    shifted = np.concatenate([data[:100], data])
    cut = lambda x: {x[a:b].tobytes() for ends in exact_dedup.chunk_ends(x, np.array([0, len(x)])) for a, b in zip([0, *ends], ends, strict=False)}
    assert b"".join(x for x in [data.tobytes()]) == data.tobytes()
    assert len(cut(data) & cut(shifted)) >= 0.8 * len(cut(data))


def test_odd_rows_exact(odd, empty):
    got = exact_dedup.dedup_exact(odd).collect()
    assert len(got) == 12 and sum(r["kept"] for r in got) == 6
    assert [r["keep_id"] for r in got if r["text_sha256"] == hashlib.sha256(b"onetwo").hexdigest()] == [5] * 4
    assert exact_dedup.dedup_exact(empty).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_ngram_join(table, seed):
    rows = corpus(seed)
    sets = {i: shingles(t) for i, t, _ in rows}
    got = {r["doc_id"]: r for r in ngram_join.join_ngrams(table(rows)).collect()}
    want = brute_components(sets)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows) - 20


def test_ngram_join_large_family(table):
    """More near copies than a block holds, of which many are linked through others only."""
    rng = random.Random(3)
    base = ["b%d" % k for k in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            w[at] = "e%d" % rng.randrange(10**6)
        rows.append((k, " ".join(w), "a"))
    block, hubs = ngram_join.BLOCK, ngram_join.HUBS
    try:
        ngram_join.BLOCK, ngram_join.HUBS = 20, 1
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_ngrams(table(rows)).collect()}
    finally:
        ngram_join.BLOCK, ngram_join.HUBS = block, hubs
    assert got == brute_components({i: shingles(t) for i, t, _ in rows})


def test_odd_rows_ngram(odd, empty):
    got = ngram_join.join_ngrams(odd).collect()
    assert len(got) == 12
    by = defaultdict(set)
    for r in got:
        by[r["component_id"]].add((r["doc_id"], r["n_shingles"]))
    assert by[4] == {(4, 1), (5, 1)} and (1, 0) in by[1] and by[None] == {(None, 0), (None, 1)} and by[7] >= {(7, 1)}
    assert ngram_join.join_ngrams(empty).count() == 0


def test_paragraphs(table):
    rng = random.Random(6)
    words = ["v%d" % k for k in range(500)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = [line(60) for _ in range(4)]
    near = shared[0].split()
    near[10] = "changed"
    rows = [(k, "\n".join([line(30), "short line", shared[k % 4] if k % 2 else " ".join(near), line(25)]), "a") for k in range(12)] + [(50, line(80) + "\n" + "short line", "a")]
    docs = table(rows)
    got = paragraphs.repeated_paragraphs(docs)
    found = {(r["doc_id"], r["paragraph"]): r for r in got.collect()}
    want = {}
    sets = {(i, k): shingles(x) for i, t, _ in rows for k, x in enumerate(t.split("\n")) if len(x.split()) >= 20}
    for key, own in sets.items():
        want.setdefault(brute_components(sets)[key], []).append(key)
    want = {k: m for m in want.values() if len(m) > 1 for k in m}
    assert set(found) == set(want)
    for key, members in want.items():
        assert found[key]["copies"] == len(members) and found[key]["keep_doc_id"] == min(members)[0] and found[key]["removed"] == (key != min(members))
        text = dict((i, t) for i, t, _ in rows)[key[0]]
        assert text[found[key]["start"] :][: found[key]["length"]] == text.split("\n")[key[1]]
    clean = {r["doc_id"]: r for r in paragraphs.without_repeats(docs, got).collect()}
    assert clean[50]["text"] == dict((i, t) for i, t, _ in rows)[50]
    assert all(len(r["text"].split("\n")) == 4 - sum(found[k]["removed"] for k in found if k[0] == i) and r["n_chars"] == len(r["text"]) for i, r in clean.items() if i != 50)


def test_paragraph_clusters_against_all_pairs(table):
    """Every line with words against every other: the bands' recall, measured, and nothing that isn't linked."""
    rng = random.Random(11)
    words = ["w%d" % k for k in range(200)]
    lines = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 7, 12, 25, 60]))) for _ in range(60)]
    texts = []
    for _ in range(160):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(lines).split(" ")
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = rng.choice(words)
            own.append(" ".join(w))
        texts.append("\n".join(own))
    sets = {(k, n): shingles(line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"))}
    root = brute_components(sets)
    clusters = defaultdict(set)
    for place, r in root.items():
        clusters[r].add(place)
    want = {frozenset(c) for c in clusters.values() if len(c) > 1}
    found = defaultdict(set)
    for r in paragraphs.repeated_paragraphs(table([(k, t, "s") for k, t in enumerate(texts)]), least_words=1).collect():
        found[r["cluster_id"]].add((r["doc_id"], r["paragraph"]))
    pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    have, wanted = pairs(found.values()), pairs(want)
    assert not have - wanted and len(have) >= 0.99 * len(wanted) and len(wanted) > 200


def test_odd_rows_paragraphs(odd, empty, table):
    assert paragraphs.repeated_paragraphs(odd).count() == 0
    line = " ".join("w%d" % k for k in range(40))
    got = paragraphs.repeated_paragraphs(table([(1, line, "a"), (1, line, "a"), (None, line + "\n" + line, "a"), (2, None, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["copies"]) for r in got) == [(0, 0, 4), (0, 1, 4), (1, 0, 4), (1, 0, 4)]
    assert sum(r["removed"] for r in got) == 3 and {r["keep_doc_id"] for r in got} == {1}
    assert paragraphs.repeated_paragraphs(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tuned_bands(0.75)
    assert 1 - (1 - 0.75**rows) ** bands >= paragraphs.RECALL and 1 - (1 - 0.2**rows) ** bands <= paragraphs.CHANCE


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(table):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 40), s) for k, s in enumerate(rng.choices(["a", "b", "c", "d", None], [50, 3, 20, 5, 4], k=300))]
    got = mixing.mix(table(rows)).collect()
    total = sum(r["size"] for r in got)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in sources.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in sources.values())
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    levels = [t / weight[s] for s, (z, t) in sources.items() if t < 3 * z - 1e-9]
    assert max(levels) == pytest.approx(min(levels)) and all(3 * z / weight[s] <= max(levels) + 1e-9 for s, (z, t) in sources.items() if t >= 3 * z - 1e-9)
    for s, (_, target) in sources.items():
        assert sum(r["taken"] for r in got if r["source"] == s) == int(target)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table(rows)).collect()))


def test_curriculum_is_inverted(spark, table):
    for knots in mixing.CURRICULA:
        area = lambda t: sum((min(t, t1) - t0) * (2 * d0 + (d1 - d0) * (min(t, t1) - t0) / (t1 - t0)) / 2 for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False) if t > t0)  # noqa: E731, B023
        rows = spark.range(11).select((F.col("id") / 10).alias("s"), mixing.invert_curriculum(F.col("id") / 10, knots).alias("t")).collect()
        assert all(area(r["t"]) / area(1.0) == pytest.approx(r["s"]) for r in rows)
    order = [r["position"] for r in mixing.training_order(mixing.mix(table([(k, "a b c " * (k % 5), "s") for k in range(40)]))).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_odd_rows_mixing(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == 12 and sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=5)
    assert mixing.mix(empty).count() == 0


def test_packing(table):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", None, "Hello  world\n\n x", "naïve café  don't  123abc!?", "tab\tand\r\n  lines 　x", "<|endoftext|> hi", "many words " * 3000, "y" * 5000, " lead", "trail "] + ["doc number %d with some words" % k for k in range(150)]
    docs = table([(k, t, "a") for k, t in enumerate(texts)])
    got = packing.pack_documents(docs, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        at = 0
        for j, r in enumerate(pieces):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 256 or j == 0
            at += r["length"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack_documents(table([])).count() == 0


def test_odd_rows_packing(odd, empty, table):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    rows = odd.collect()
    got = packing.pack_documents(odd).collect()
    count = lambda pairs: sorted(pairs, key=str)
    totals = defaultdict(int)
    for r in rows:
        totals[r["doc_id"]] += len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    found = defaultdict(int)
    for r in got:
        found[r["doc_id"]] += r["length"]
    assert found == totals and count(r["doc_id"] for r in got if r["piece"] == 0) == count(r["doc_id"] for r in rows)
    assert packing.pack_documents(empty).count() == 0
    long = [" " * 1_000_000 + "x", "word" * 250_000, "\u3000" * 100_000]
    got = packing.cut_pieces(table([(k, t, "a") for k, t in enumerate(long)])).collect()
    for k, t in enumerate(long):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for r in (r for r in got if r["doc_id"] == k):
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in got if r["doc_id"] == k) == len(ids)


def test_packing_plan_against_the_optimum():
    rng = random.Random(1)

    def optimum(items, room):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in {v: j for j, v in enumerate(bins) if v + items[k] <= room}.values():
                place(k + 1, [v + items[k] if j == b else v for j, v in enumerate(bins)])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    worse = 0
    for _ in range(400):
        room = rng.choice([10, 20, 37])
        items = sorted((rng.randint(1 if rng.random() < 0.5 else room // 4, room) for _ in range(rng.randint(0, 9))), reverse=True)
        runs, n = packing.plan_runs(Counter(items), room)
        places = [(s + j, o, w, r + j) for w, r, k, s, o in runs for j in range(k)]
        assert Counter(w for _, _, w, _ in places) == Counter(items)
        assert all(sorted(r for _, _, x, r in places if x == w) == list(range(c)) for w, c in Counter(items).items())
        for s in {p[0] for p in places}:
            at = 0
            for _, o, w, _ in sorted(p for p in places if p[0] == s):
                assert o == at
                at += w
            assert at <= room
        worse += n > optimum(items, room)
    assert worse <= 4


def test_fingerprints(table):
    rows = corpus(7, 60)
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(table(rows)).collect()}
    ids = sorted((i for i, _, _ in rows), reverse=True)
    texts = {i: t for i, t, _ in rows}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        m = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if t == after:
            assert got[i]["near_next"] == 1
    prints = defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) >= len({frozenset(Counter(x for x in t.split("\n") if x.strip()).items()) for t in prints})


def test_fingerprints_add_and_delete(table):
    docs = table([(1, "a b.\nc d.", "s"), (2, "c d.\na b.", "s"), (3, "a b.", "s"), (4, "c d.", "s")])
    f = fingerprints.fingerprints(docs)
    rows = {r["doc_id"]: r for r in f.collect()}
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]
    joined = f.filter("doc_id = 3").select(F.col("wide").alias("a")).crossJoin(f.filter("doc_id = 4").select(F.col("wide").alias("b")))
    assert joined.select(fingerprints.add(F.col("a"), F.col("b"))).first()[0] == rows[1]["wide"]
    whole = f.filter("doc_id = 1").select(F.col("wide").alias("a")).crossJoin(f.filter("doc_id = 4").select(F.col("wide").alias("b")))
    assert whole.select(fingerprints.add(F.col("a"), F.col("b"), -1)).first()[0] == rows[3]["wide"]


def test_likeness_tracks_shared_sentences(table):
    text = lambda a, b: " ".join(f"s{k} t{k}." for k in range(a, b))
    rows = [(3, text(0, 90), "s"), (2, text(30, 120), "s"), (1, text(500, 590), "s")]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(table(rows)).collect()}
    assert got[3]["near_next"] == pytest.approx(2 / 3, abs=0.25) and got[2]["near_next"] < 0.3 and got[2]["near_edited"] > 0.4


def text_pieces(text):
    """The multiset of pieces by its definition: four words each, from the begin of each sentence of each line."""
    found = Counter()
    for sentence in re.split(r"[.!?][\x20\x09]+|\n", text):
        w = SPLIT.findall(sentence)
        found.update(tuple(w[k : k + 4]) for k in range(0, len(w), 4))
    return found


def cosine(a, b):
    dot = sum(n * b[k] for k, n in a.items())
    size = sum(n * n for n in a.values()) * sum(n * n for n in b.values())
    return 1.0 if a == b else dot / size**0.5 if size else 0.0


def test_fingerprint_values_against_plain_hashing(table):
    import xxhash

    four, eight = (lambda x, seed: xxhash.xxh64_intdigest((x).to_bytes(4, "little"), seed)), (lambda x, seed: xxhash.xxh64_intdigest((x).to_bytes(8, "little"), seed))
    texts = [t for _, t, _ in corpus(12, 30)] + ["one. two three four five six! seven", "é ü\n\n \t\nzwei drei", "a b c d " * 2000]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(table([(k, t, "s") for k, t in enumerate(texts)])).collect()}
    for k, text in enumerate(texts):
        wide = []
        for seed in fingerprints.SEEDS:
            hashes = [xxhash.xxh64_intdigest(p.encode(), four(seed, 42)) for p in text.split("\n") if SPLIT.search(p)]
            wide += [sum(h & 0xFFFFFFFF for h in hashes) % 2**32, sum(h >> 32 for h in hashes) % 2**32]
        assert got[k]["wide"] == wide
        counts = [0] * 320
        for piece, n in text_pieces(text).items():
            h = 42
            for word in piece:
                h = xxhash.xxh64_intdigest(word.encode(), h)
            for j in range(5):
                own = four(j, eight(h, 42)) if j else h
                for bit in range(64):
                    counts[64 * j + bit] += n * (own >> bit & 1)
        found = [v >> 32 * f & (1 << 32) - 1 for j in range(5) for f in range(2) for v in got[k]["votes"][1 + 32 * j : 33 + 32 * j]]
        assert found == counts and got[k]["votes"][0] == sum(text_pieces(text).values())


def test_likeness_is_near_the_truth(spark):
    """Over all documents of a given table: errors at the 95th percentile, and edited texts that keep two thirds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got, ids = fingerprints.compare_edited(docs).collect(), sorted(texts, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    errors = defaultdict(list)
    for r in got:
        t, n = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        m = len(t) // 3
        own = text_pieces(t)
        errors["edited"].append(abs(r["near_edited"] - cosine(own, text_pieces(t[: len(t) - m] + n[:m]))))
        errors["next"].append(abs(r["near_next"] - cosine(own, text_pieces(n))))
    assert len(got) == len(texts) and all(np.quantile(e, 0.95) < 0.1 for e in errors.values())
    assert np.quantile([r["near_edited"] for r in got if len(texts[r["doc_id"]]) > 200], 0.05) > 0.4


def test_neighbours_of_repeated_rows(table):
    rows = [(5, "aaaaaa", "s"), (5, "aaaaaa", "s"), (3, "bbb", "s"), (None, "cccccc", "s"), (None, "cccccc", "s"), (0, "cccccc", "s")]
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.compare_edited(table(rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter({(5, sha("aaaaaa")): 1, (5, sha("aaaabb")): 1, (3, sha("bbc")): 1, (0, sha("cccccc")): 1, (None, sha("cccccc")): 1, (None, sha("ccccaa")): 1})


def test_odd_rows_fingerprints(odd, empty, table):
    assert fingerprints.compare_edited(odd).count() == 12
    assert fingerprints.compare_edited(empty).count() == 0
    r = fingerprints.compare_edited(table([(1, "abcdef", "s")])).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1


def test_quality(spark, table):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 90))) + "."
    bad = lambda: rng.choice([" ".join(["Spam"] * rng.randint(20, 60)), " ".join(w.upper() + "!!" for w in good().split())])
    marks = [rng.random() < 0.7 for _ in range(500)]
    docs = table([(k, good() if m else bad(), "a") for k, m in enumerate(marks)] + [(900, None, "a"), (901, "", "a"), (None, "x y", "a")])
    labels = spark.createDataFrame([(k, int(m), 0) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(500))
    held = [k for k in range(500) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == marks[k] for k in held) >= 0.95 * len(held)
    # held-out labels have no part in the scores
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def plain_statistics(text):
    """The statistics by their definitions, word by word."""
    raw, w = text.encode(), SPLIT.findall(text)
    size, n, lines = len(raw), len(w), text.count("\n")
    per_byte, per_word = 1 / max(size, 1), 1 / max(n, 1)
    lower = [x.translate(LOWER) for x in w]
    triples = [tuple(lower[k : k + 3]) for k in range(n - 2)]
    is_upper = lambda c: "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de"
    count = lambda chars: sum(text.count(c) for c in chars) * per_byte
    shouts = [sum(map(is_upper, x)) >= 2 and not re.search("[a-z]", x) for x in w]
    return {
        "log_points": np.log1p(len(text)), "log_words": np.log1p(n), "word_mean": sum(len(x.encode()) for x in w) * per_word, "word_longest": max((len(x.encode()) for x in w), default=0),
        "words_distinct": len(set(lower)) * per_word, "word_top_share": max(Counter(lower).values(), default=0) * per_word, "adjacent_same": sum(a == b for a, b in zip(lower, lower[1:], strict=False)) * per_word,
        "shingles_repeated": 1 - len(set(triples)) / len(triples) if n >= 6 else 0.0, "lines": lines, "line_mean": size / (lines + 1), "lines_repeated": 1 - len(set(text.split("\n"))) / (lines + 1) if n and lines else 0.0,
        "upper": sum(map(is_upper, text)) * per_byte, "digit": count("0123456789"), "mark": count(".,;:!?'\"()-"), "symbol": count("#$%&*+/<=>@[\\]^_`{|}~"), "bang": count("!"), "non_ascii": sum(b >= 128 for b in raw) * per_byte,
        "space": count(" \t\n\v\f\r"), "end_marked": sum(x[-1] in ".!?" for x in w) * per_word, "bang_words": sum(x[-1] == "!" for x in w) * per_word, "capital_words": sum(is_upper(x[0]) for x in w) * per_word,
        "shout_words": sum(shouts) * per_word, "short_words": sum(len(x.encode()) <= 2 for x in w) * per_word, "vowels": count("aeiouyAEIOUY"),
    }


def test_quality_statistics_against_plain_python(odd):
    texts = [t for _, t, _ in corpus(9, 60)] + ["", "ÀB ÉT été x!", "A a a B! 12 #\n\nA a a B! 12 #\n", "WORDS! \t\v more; words? (yes)", "one"]
    rows = odd.sparkSession.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.with_statistics(rows).collect()}
    for k, t in enumerate(texts):
        for name, value in plain_statistics(t).items():
            assert got[k][name] == pytest.approx(value), (name, t)


def test_rules_and_scores_against_plain_evaluation(spark):
    """Rules are the paths of the trees that they are read from, and the compiled column scores as the rules do one by one."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    values = rng.uniform(0, 1, (300, len(quality.STATISTICS)))
    label = (values[:, 2] + 0.3 * values[:, 5] > 0.6).astype(int)
    rows = spark.createDataFrame([(int(k), int(y), *map(float, v)) for k, (y, v) in enumerate(zip(label, values, strict=True))], ["k", "label", *quality.STATISTICS])
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=5).fit(VectorAssembler(inputCols=list(quality.STATISTICS), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double"))))
    holds = lambda rule, v: all(over < v[quality.STATISTICS.index(name)] <= most for name, over, most in rule.bounds)

    def leaf_paths(node, v):
        """Bounds met on the way down, walked in the tree itself."""
        met = []
        while node.numDescendants() > 0:
            split = node.split()
            name, at = quality.STATISTICS[split.featureIndex()], split.threshold()
            left = v[split.featureIndex()] <= at
            met.append((name, "<=" if left else ">", at))
            node = node.leftChild() if left else node.rightChild()
        return met

    for tree in forest.trees:
        rules = quality.tree_rules(tree.toDebugString)
        assert len(rules) == tree.numNodes - 1
        for v in values[:40]:
            # the rules that hold are the nodes on the way to the leaf
            assert sum(holds(r, v) for r in rules) == len(leaf_paths(tree._java_obj.rootNode(), v))
    model = quality.fit(rows.drop("k"))
    assert model.rules
    for r in rows.select("k", model.score().alias("score")).collect():
        v = values[r["k"]]
        margin = model.intercept + sum(w for rule, w in model.rules if holds(rule, v)) + sum(min(max(v[quality.STATISTICS.index(s)], lo), hi) * w for s, lo, hi, w in model.linear)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)))


BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def test_secrets_base_matches_the_definition(table):
    rng = random.Random(5)
    bits = ["password: ", "TOKEN=", "api_key = '", "apiKey\":\"", "secret", "=", " ", "AKIA", "0123456789abcdef", "ABCD1234EFGH5678", "deadbeef", "é", "\n", "hunter2hunter2", "x", "ſecret=abcdefghijklmnop ", "%41", "token: token: "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)] + [None, ""]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(table([(k, t, "a") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        want = []
        for rank, (kind, (pattern, group, fewest)) in enumerate(BASE.items()):
            want += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t or "") if len(m[group]) >= fewest]
        spans = [x[2] for x in sorted(want)]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == tuple(sum(x[1] == j for x in want) for j in range(3))
        assert set(spans) <= set(filter(None, got[k]["spans"].split(",")))


def test_secrets_in_layers():
    import base64
    import gzip
    import urllib.parse

    inner = "secret: abcdefghijklmnop1234"
    b64 = lambda x: base64.b64encode(x).decode()
    wrapped = [b64(inner.encode()), b64(gzip.compress(inner.encode())), b64(b64(inner.encode() + b" pad").encode()), "".join(f"\\u{ord(c):04x}" for c in inner), urllib.parse.quote(b64(inner.encode()), safe=""), gzip.compress(inner.encode()).hex()]
    for x in wrapped:
        text = f"before {x} after"
        _, every = secrets.find(text)
        assert any(kind == "assign" and 7 <= s < e <= 7 + len(x) for s, kind, e in every), x
    assert secrets.find("password%3Dabc%64efghijklmnop")[1] == [(0, "assign", 29)]
    loop = "%2525252541" * 50
    assert secrets.find(loop) == ([], [])
