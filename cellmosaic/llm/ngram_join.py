"""N-gram Jaccard join of documents by vertical partitioning, reported as connected components.

Documents with equal shingle sets are one class. Most classes have no partner: a partner would share all but a quarter of
their shingles, so among the first few of each class in a global order enough must occur elsewhere; counting that, fragment by
fragment of the shingle space, leaves the survivors. Their shingles are ordered by document frequency, rarest first, and two
classes are compared if they share one of the first quarter. Comparison cuts that global order into ranges that hold about
equally many shingles, counts each pair's overlap in each range, and sums.

Components don't need every pair: a shingle's members are first compared with a few of them, its hubs. Then only pairs of
different components are open; while those are too many, members outside a shingle's largest component become hubs in turn. What
is still open is held, pair by pair, against an exact bound from bitmaps of the sets, in blocks, and what it lets through is
compared. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm import shingles
from cellmosaic.llm.common import components, cut, join_unique, splitmix

#: Documents link at this Jaccard similarity, in hundredths.
PERCENT = 75
#: Shingles that one task of a fragment should hold about.
FRAGMENT = 1_000_000
#: Fewest ranges of the global order that the overlap of a pair is counted in, and shingles of a set that a range should hold at most.
PARTS, RANGE = 4, 100_000
#: Rows of blocks for each open entry up to which no more hubs are tried, and most turns of hubs.
OPEN, TURNS = 4, 6
#: Hubs that each entry's members are first compared with, members of an entry that one task compares, and bits of a set's bitmap.
HUBS, BLOCK, BITMAP = 3, 1000, 2048


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares at least with any partner."""
    return -(-n * percent // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    """How many shared shingles the filter asks of a prefix that is longer by as many, less one."""
    return np.maximum(1, n // 8)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two = [], [], []
        for _, _, hashes, at in shingles.blocks(batch.column(2)):
            a, b = shingles.set_digests(hashes, at)
            n.append(np.diff(at))
            one.append(a.view(np.int64))
            two.append(b.view(np.int64))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), join(n), join(one), join(two)], ["doc_id", "text_key", "n", "node", "check"])


def _owners(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, place = np.unique(owner, return_inverse=True)
    return ids, place.astype(np.uint16)


def _dealt(fragments: int, percent: int, prefix: bool):
    """Rows of a fragment: shingles (their low bits choose the fragment), the place of each one's class in `nodes`, and the classes' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, hashes, at in shingles.blocks(batch.column(0)):
                nodes, n = shingles.set_digests(hashes, at)[0].view(np.int64), np.diff(at)
                new = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], dtype=bool) & (n > 0)
                take = np.where(new, n - _needed(n, percent) + _extra(n) if prefix else n, 0)
                take = np.minimum(take, n)
                rows = np.repeat(np.arange(len(n)), take)
                picked = hashes[np.repeat(at[:-1], take) + np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take)]
                part = (picked % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                picked, rows, part = picked[order], rows[order], part[order]
                edges = np.searchsorted(part, np.arange(fragments + 1))
                out: list[tuple] = []
                for f in np.flatnonzero(np.diff(edges)):
                    a, b = edges[f], edges[f + 1]
                    own, place = _owners(rows[a:b])
                    kept = (picked[a:b] // np.uint64(fragments)).astype(np.uint32) if prefix else picked[a:b]
                    out.append((int(f), kept.tobytes(), place.tobytes(), nodes[own].tobytes(), n[own].astype(np.uint32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], ["fragment", "tokens", "places", "nodes", "sizes"])

    return run


_DEALT = "fragment long, tokens binary, places binary, nodes binary, sizes binary"


def _gathered(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a fragment with the class and set size of each."""
    tokens, nodes, sizes = [], [], []
    for t, p, o, s in zip(*(table.column(c) for c in ("tokens", "places", "nodes", "sizes")), strict=True):
        place = np.frombuffer(p.as_py(), np.uint16)
        tokens.append(np.frombuffer(t.as_py(), kind))
        nodes.append(np.frombuffer(o.as_py(), np.int64)[place])
        sizes.append(np.frombuffer(s.as_py(), np.uint32)[place])
    return np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)


def _groups(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by shingle and drops repeats of a class, and how many classes have each shingle in that order."""
    order = np.lexsort((nodes, tokens))
    t, o = tokens[order], nodes[order]
    fresh = np.ones(len(t), dtype=bool)
    fresh[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    order, t = order[fresh], t[fresh]
    begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    have = np.diff(np.r_[begin, len(t)])
    return order, np.repeat(have, have)


def _count_shared(owners: int):
    """Of a fragment, how many shared shingles each class has, dealt to parts by class."""

    def run(table: pa.Table) -> pa.Table:
        tokens, nodes, sizes = _gathered(table, np.uint32)
        order, have = _groups(tokens, nodes)
        kept = order[have > 1]
        ids, first, n = np.unique(nodes[kept], return_index=True, return_counts=True)
        size, part = sizes[kept][first], ids.view(np.uint64) % np.uint64(owners)
        some = np.unique(part)
        pick = [part == p for p in some]
        return pa.table([pa.array(some.astype(np.int64)), *(pa.array([x[k].tobytes() for k in pick], pa.binary()) for x in (ids, size, n.astype(np.uint32)))], names=["part", "nodes", "sizes", "counts"])

    return run


def _enough(percent: int):
    """Of a part, the classes that share as many shingles of their prefix as any with a partner would."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, k: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), k)
        nodes, sizes, counts = read("nodes", np.int64), read("sizes", np.uint32), read("counts", np.uint32)
        ids, first, place = np.unique(nodes, return_index=True, return_inverse=True)
        n, shared = sizes[first].astype(np.int64), np.bincount(place, weights=counts, minlength=len(ids))
        return pa.table({"node": pa.array(ids[shared >= _extra(_needed(n, percent))], pa.int64())})

    return run


def _shared_tokens(owners: int):
    """Of a fragment, the shingles that more than one class has, dealt to parts by class."""

    def run(table: pa.Table) -> pa.Table:
        tokens, nodes, sizes = _gathered(table, np.uint64)
        order, have = _groups(tokens, nodes)
        keep = have > 1
        order, have = order[keep], have[keep]
        part = (nodes[order].view(np.uint64) % np.uint64(owners)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        order, have, part = order[by], have[by], part[by]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        rows = [(int(part[a]), tokens[order[a:b]].tobytes(), nodes[order[a:b]].tobytes(), sizes[order[a:b]].tobytes(), have[a:b].astype(np.uint32).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["part", "tokens", "nodes", "sizes", "have"])

    return run


def bitmap(tokens: np.ndarray) -> bytes:
    """For each place whether an odd number of shingles fall on it; sets that differ in d places differ in d shingles at least."""
    places = splitmix(tokens.view(np.uint64)) & np.uint64(BITMAP - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=BITMAP) & 1).astype(bool)).tobytes()


def _ordered(percent: int):
    """Of the classes in a part that share enough, the shared shingles rarest first and how many of them are in the prefix."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, k: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), k)
        tokens, nodes, sizes, have = read("tokens", np.int64), read("nodes", np.int64), read("sizes", np.uint32), read("have", np.uint32)
        have = np.minimum(have, MOST_HAVE)
        order = np.lexsort((tokens.view(np.uint64), have, nodes))
        tokens, nodes, sizes, have = tokens[order], nodes[order], sizes[order].astype(np.int64), have[order].astype(np.int32)
        begin = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, np.int64)
        shared = np.diff(np.r_[begin, len(nodes)])
        n = sizes[begin]
        need = _needed(n, percent)
        kept = np.flatnonzero(shared >= need)
        return pa.table({
            "node": pa.array(nodes[begin[kept]], pa.int64()), "n": pa.array(n[kept], pa.int64()),
            # shingles that no other class has come first in the order, and fill part of the prefix
            "prefix": pa.array((shared - need + 1)[kept], pa.int32()),
            "tokens": pa.array([tokens[begin[k] : begin[k] + shared[k]] for k in kept], pa.list_(pa.int64())),
            "have": pa.array([have[begin[k] : begin[k] + shared[k]] for k in kept], pa.list_(pa.int32())),
            "alone": pa.array((n - shared)[kept], pa.int64()),
            "bits": pa.array([bitmap(tokens[begin[k] : begin[k] + shared[k]]) for k in kept], pa.binary()),
        })

    return run


def survivors(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a partner: node, n, prefix, tokens (shared shingles, rarest first), alone (how many others), bits."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    fragments = max(8, total // (2 * FRAGMENT))
    counted = docs.select("text").mapInArrow(_dealt(fragments, percent, True), _DEALT).groupBy("fragment").applyInArrow(_count_shared(fragments), "part long, nodes binary, sizes binary, counts binary")
    enough = counted.groupBy("part").applyInArrow(_enough(percent), "node long")
    maybe = cut(enough.join(classes, "node").select("n", "rep_id", "rep_key"))
    left = maybe.agg(F.sum("n")).first()[0] or 0
    same = F.col("d.doc_id").eqNullSafe(F.col("m.rep_id")) & (F.col("d.text_key") == F.col("m.rep_key"))
    texts = docs.alias("d").join(maybe.hint("merge").alias("m"), same, "left_semi")  # grows with the documents: never broadcast
    fragments, parts = max(8, left // FRAGMENT), max(8, left // FRAGMENT)
    dealt = texts.select("text").mapInArrow(_dealt(fragments, percent, False), _DEALT)
    shared = dealt.groupBy("fragment").applyInArrow(_shared_tokens(parts), "part long, tokens binary, nodes binary, sizes binary, have binary")
    return cut(shared.groupBy("part").applyInArrow(_ordered(percent), "node long, n long, prefix int, tokens array<long>, have array<int>, alone long, bits binary"))


#: The global order tells apart shingles of up to so many classes; beyond, only their bits count.
MOST_HAVE = (1 << 19) - 1


def order_keys(tokens: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Places in the global order: first by how many classes have a shingle, then by its bits."""
    return ((np.minimum(have, MOST_HAVE).astype(np.uint64) << np.uint64(44)) | (tokens.view(np.uint64) >> np.uint64(20))).view(np.int64)


def _set_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and place in the order of a batch's sets (.., tokens, have)."""
    tokens, have = batch.column(2), batch.column(3)
    row = np.repeat(np.arange(len(batch)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    flat = tokens.flatten().to_numpy()
    return row, flat, order_keys(flat, have.flatten().to_numpy())


def _quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, keys = _set_keys(batch)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(np.quantile(keys, np.linspace(0, 1, 65), method="nearest"))], ["key"])


def pivots(sets: DataFrame, parts: int) -> list[int]:
    """Places that cut the global order into ranges of about as many shingles; only balance depends on them."""
    found = sets.mapInArrow(_quantiles, "key long").agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 1000)).first()[0]
    return sorted(set(found or []))


def _ranges(cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tokens, keys = _set_keys(batch)
            part = np.searchsorted(np.array(cuts, dtype=np.int64), keys, "right")
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[begin, len(row)].astype(np.int32))
            own = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(part[begin].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(tokens))], ["node", "n", "part", "tokens"])

    return run


def overlaps(pairs: DataFrame, sets: DataFrame, cuts: list[int]) -> DataFrame:
    """Pairs (a, b) with the sizes na, nb and overlap of their sets (node, n, tokens, have): counted by range, then summed.

    Tokens are in the global order; pairs without any range in common are left out.
    """
    pieces = sets.select("node", "n", "tokens", "have").mapInArrow(_ranges(cuts), "node long, n long, part int, tokens array<long>")
    # both joins deal the pieces alike, so that they are shuffled once
    dealt = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
    one = dealt.hint("merge").join(pieces.select(F.col("node").alias("a"), F.col("n").alias("na"), "part", F.col("tokens").alias("ta")), ["a", "part"])
    two = one.hint("merge").join(pieces.select(F.col("node").alias("b"), F.col("n").alias("nb"), "part", F.col("tokens").alias("tb")), ["b", "part"])
    partial = two.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps of their sets don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, alone = (batch.column(k).to_numpy() for k in range(4))
            one, two = (np.frombuffer(b"".join(x.as_py() for x in batch.column(k)), np.uint8).reshape(len(a), BITMAP // 8) for k in (4, 5))
            apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) + alone
            near = apart * (100 + percent) <= n * (100 - percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])

    of = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("alone").alias(f"u{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", F.col("na") + F.col("nb"), F.col("ua") + F.col("ub"), "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _close(percent: int):
    """Of each unit's members, those pairs of different components whose sets may still be similar: node and its partners.

    Sets whose bitmaps differ in d places differ in d shingles at least, beside those that only one class has. That bound is
    exact, so no similar pair is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        unit, node, component, n, alone = (table.column(c).to_numpy() for c in ("unit", "node", "component", "n", "alone"))
        bits = np.frombuffer(b"".join(x.as_py() for x in table.column("bits")), np.uint8).reshape(len(unit), BITMAP // 8)
        order = np.argsort(unit, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(unit[order]) != 0, True]) if len(unit) else np.zeros(1, np.int64)
        out_node, out_partners = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            flags = np.unpackbits(bits[own], axis=1).astype(np.float32)
            ones = flags.sum(axis=1)
            for lo in range(0, len(own), 512):
                some = own[lo : lo + 512]
                apart = ones[lo : lo + 512, None] + ones[None, :] - 2 * (flags[lo : lo + 512] @ flags.T) + alone[some][:, None] + alone[own][None, :]
                sizes = n[some][:, None] + n[own][None, :]
                near = (apart * (100 + percent) <= sizes * (100 - percent)) & (component[some][:, None] != component[own][None, :]) & (node[some][:, None] < node[own][None, :])
                for k in np.flatnonzero(near.any(axis=1)):
                    out_node.append(node[some[k]])
                    out_partners.append(node[own[near[k]]].tobytes())
        return pa.table({"node": pa.array(out_node, pa.int64()), "partners": pa.array(out_partners, pa.binary())})

    return run


def _distinct_pairs(table: pa.Table) -> pa.Table:
    node = table.column("node").to_numpy()
    partners = [np.frombuffer(x.as_py(), np.int64) for x in table.column("partners")]
    pairs = np.unique(np.stack([np.repeat(node, [len(x) for x in partners]), np.concatenate(partners)]), axis=1) if len(node) else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


class _Comparison:
    """Comparison of classes (node, n, tokens, have, alone, bits) that share entries (node, n, token), until all links between components are known."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.cuts = pivots(sets.select("node", "n", "tokens", "have"), max(PARTS, -(-(sets.agg(F.max("n")).first()[0] or 0) // RANGE)))

    def links(self, pairs: DataFrame) -> DataFrame:
        similar = F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * self.percent
        return cut(overlaps(pairs, self.sets, self.cuts).filter(similar).select("a", "b"))

    def with_hubs(self, entries: DataFrame, hubs: DataFrame, total: int) -> DataFrame:
        """Links of entries' nodes with the hubs (token, k, hubs) of their tokens; a token that many entries have is not dealt to one task."""
        met = join_unique(entries, hubs, ["token"], "k", total).withColumn("h", F.explode("hubs"))
        met = met.filter((F.col("node") != F.col("h.node")) & (F.least("n", "h.n") * 100 >= F.greatest("n", "h.n") * self.percent))
        if "component" in entries.columns:
            met = met.filter(F.col("component") != F.col("h.component"))
        pairs = met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
        return self.links(_bounded(pairs, self.sets, self.percent))

    def in_blocks(self, now: DataFrame, many: int) -> DataFrame:
        """Links of all pairs of different components that share a token; tokens with many entries are dealt out as pairs of blocks."""
        block, count = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.when(F.col("k") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("k") / BLOCK))
        units = now.withColumn("blocks", count).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        units = units.withColumn("unit", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))).join(self.sets.select("node", "alone", "bits"), "node")
        close = units.select("unit", "node", "component", "n", "alone", "bits").groupBy(F.pmod("unit", F.lit(max(32, many // 4000))).alias("part")).applyInArrow(_close(self.percent), "node long, partners binary")
        return self.links(close.groupBy(F.pmod(F.xxhash64("node"), F.lit(max(16, many // 4000))).alias("part")).applyInArrow(_distinct_pairs, "a long, b long"))


def _picked(*order) -> list:
    """HUBS members of a group, by an order that differs from turn to turn."""
    return [F.min(F.struct(F.xxhash64("node", F.lit(t)), *order)).alias(f"h{t}") for t in range(HUBS)]


def _as_hubs(found: DataFrame, *fields: str) -> DataFrame:
    return found.select("token", "k", F.array_distinct(F.array(*[F.struct(*[F.col(f"h{t}")[f].alias(f) for f in fields]) for t in range(HUBS)])).alias("hubs"))


def _open(entries: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Entries of tokens whose members are in several components, with the component and how many the token has (k)."""
    now = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = now.groupBy("token").agg(F.count("*").alias("k"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("token", "k")
    return cut(join_unique(now, spread, ["token"], "k", total))


def linked_classes(sets: DataFrame, percent: int = PERCENT, entries: DataFrame | None = None) -> DataFrame | None:
    """Components (node, component) of the classes (node, n, prefix, tokens, have, alone, bits) that link; None if none does.

    Classes are compared if they share an entry (node, n, token); by default the entries are the shingles of the prefixes.
    """
    if entries is None:
        entries = cut(sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")))
    total, compare = entries.count(), _Comparison(sets, percent)
    hubs = _as_hubs(entries.groupBy("token").agg(F.count("*").alias("k"), *_picked("node", "n")).filter("k > 1"), "node", "n")
    labels = cut(components(compare.with_hubs(entries, hubs, total)))
    as_edges = lambda x: x.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    now = _open(entries, labels, total)
    for turn in range(TURNS + 1):
        size = now.agg(F.count("*").alias("n"), F.sum(F.when(F.col("k") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("k") / BLOCK))).alias("rows")).first()
        if not size["n"]:
            break
        last = turn == TURNS or size["rows"] <= OPEN * size["n"]
        if last:
            more = compare.in_blocks(now, size["rows"])
        else:
            # hubs outside the largest component: where all others are hubs, nothing stays open
            largest = now.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("k"))
            outside = join_unique(now.drop("k"), largest, ["token"], "k", size["n"]).filter("component <> largest")
            hubs = cut(_as_hubs(outside.groupBy("token", "k").agg(*_picked("node", "n", "component")), "node", "n", "component"))
            more = compare.with_hubs(now.drop("k"), hubs, size["n"])
        if not more.isEmpty():
            labels = cut(components(more.union(as_edges(labels))))
        if last:
            break
        done = hubs.select("token", F.explode("hubs").alias("h")).select("token", "h.node")  # compared with all members
        now = _open(now.select("node", "n", "token").join(done, ["token", "node"], "left_anti"), labels, size["n"])
    return None if labels.isEmpty() else labels


def join_ngrams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_key (a hash of the text as it is).

    Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id reachable. Texts of fewer words have one shingle, null texts and texts without words
    none and link with nothing. Rows of equal sets are linked whatever their ids; a null id is no candidate for component_id unless
    all ids reachable are null. An empty table gives no rows. Sets are compared by 64-bit shingle hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    made = cut(rows.select("doc_id", "text_key", "text").mapInArrow(_signatures, "doc_id long, text_key long, n long, node long, check long"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("rep")
    classes = cut(made.filter("n > 0").groupBy("node", "check", "n").agg(rep, F.count("*").alias("copies")).select("node", "check", "n", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")))
    labels = linked_classes(survivors(rows, classes, percent), percent)
    if labels is None:
        named = classes.withColumn("component_id", F.col("rep_id"))
    else:
        joined = classes.join(labels, "node", "left")
        linked = joined.filter(F.col("component").isNotNull())
        least = linked.groupBy("component").agg(F.min("rep_id").alias("component_id"), F.count("*").alias("members"))
        linked = join_unique(linked, least, ["component"], "members", labels.count())
        columns = ["node", "check", "n", "copies", "component_id"]
        named = linked.select(*columns).unionByName(joined.filter(F.col("component").isNull()).withColumn("component_id", F.col("rep_id")).select(*columns))
    named = cut(named.select("node", "check", "n", "copies", "component_id"))
    full = join_unique(made.filter("n > 0"), named, ["node", "check", "n"], "copies", made.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key")
    return full.unionByName(made.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key"))


def op4(spark, sf_dir: str) -> DataFrame:
    return join_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
