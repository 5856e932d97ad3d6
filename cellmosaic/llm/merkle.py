"""A Merkle manifest of a dataset by time-forward processing: digests go up the trees as messages, proofs come down.

Every partition of the dataset (a value of `lang`) has a tree over its rows in order; the partitions' subroots have one over them. A
node is labelled by its level and its place there. Children send their digests to their parent's label through a priority queue
ordered by label, so that a node's messages are there when its turn comes. The queue is external: what is addressed to a block of
8^4 neighbouring nodes lies in a table that the shuffle orders by label, and a task streams over it and holds one block's part of
the queue. The block's root goes into the next table. A reversed sweep takes the tables from the last to the first, and delivers to
each node what its proof has beyond it.
"""

from __future__ import annotations

import hashlib
import heapq
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import cut

#: Nodes that a parent digests, and levels of a tree that one sweep passes.
FANOUT, LEVELS = 8, 4
#: Nodes of a block.
BLOCK = FANOUT**LEVELS

_SUFFIX = "lefts array<string>, rights array<string>, subroot string, root string"
#: A message: to a block of a group, from the node at `index`, or for index -1 from above.
_MESSAGE = ("grp", "block", "index", "digest", "n", "lefts", "rights", "subroot", "root")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_above(n: int) -> int:
    """Levels over n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): tampered is null where a row's text isn't touched."""
    text, number = F.col("text").cast("string"), F.col("doc_id").cast("long").cast("string")
    head = F.concat(_field(number), _field(F.col("source").cast("string")), _field(F.col("lang").cast("string")), _field(F.col("n_chars").cast("long").cast("string")))
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    lang = F.col("lang").cast("string")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.concat(head, _field(text)), 256).alias("leaf"),
        F.when(F.crc32(number) % 3 == 0, F.sha2(F.concat(head, _field(lower)), 256)).alias("tampered"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, group, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for g in batch.column("grp").to_pylist():
            group, place = (g, place + 1) if g == group else (g, 0)
            places.append(place)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their `index` within grp by order, and the group's size n.

    A range sort over groups and order together spreads a large group over tasks; each counts on from what earlier ones hold.
    """
    schema = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    placed = cut(nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).mapInArrow(_numbered, f"{schema}, part long, place long"))
    by_part = Window.partitionBy("grp").orderBy("part")  # a row per group and task
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("k"))
    counts = counts.select("grp", "part", (F.sum("k").over(by_part) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("grp")).alias("n"))
    return placed.join(counts, ["grp", "part"]).withColumn("index", F.col("before") + F.col("place")).drop("part", "place", "before")


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of one block after the other, from batches sorted by block and index."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if rows and row[:2] != rows[-1][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _passed_up(nodes: list[tuple[int, str]], top: int) -> dict[tuple[int, int], str]:
    """Digests of a block's nodes by label, from those at its lowest level in order."""
    known = {(0, i): d for i, d in nodes}
    # messages (label of the receiver, place among its children, digest), already in order
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in nodes] if top else []
    while queue:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        known[level, index] = own = digest("".join(children))
        if level < top:
            heapq.heappush(queue, (level + 1, index // FANOUT, index % FANOUT, own))
    return known


def _passed_down(known: dict[tuple[int, int], str], top: int, above) -> Iterator[tuple[int, tuple, str]]:
    """Of each node at the lowest level, by descending label: its index, its path (left, right, path of the parent) and the siblings' text up to the root.

    `above` is the path of the block's root; None at the root of all.
    """

    def text(path) -> str:
        out = []
        while path:
            out += path[:2]
            path = path[2]
        return "".join(out)

    last = max((i for level, i in known if level == top), default=0)
    queue = [(-top, -last, above, text(above))]
    while queue:
        level, index, path, proof = heapq.heappop(queue)
        level, index = -level, -index
        if not level:
            yield index, path, proof
            continue
        children = [known[at] for at in ((level - 1, index * FANOUT + s) for s in range(FANOUT)) if at in known]
        for s in range(len(children)):
            left, right = "".join(children[:s]), "".join(children[s + 1 :])
            heapq.heappush(queue, (1 - level, -(index * FANOUT + s), (left, right, path), left + right + proof))


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches, ["grp", "block", "index", "digest", "n"]):
        grp, block, _, _, n = rows[0]
        top = min(LEVELS, levels_above(n))
        known = _passed_up([(r[2], r[3]) for r in rows], top)
        root = known[top, rows[0][2] // FANOUT**top]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((grp, pa.string()), (block, pa.int64()), (root, pa.string()), (-(-n // FANOUT**top), pa.int64()))], ["grp", "index", "digest", "n"])


def _swept(rows: list[tuple]) -> tuple[tuple, Iterator[tuple[int, tuple, str]]]:
    """What came from above to a block, and its nodes' paths."""
    head, nodes = rows[0], rows[1:]
    path = None
    for left, right in zip(reversed(head[5]), reversed(head[6]), strict=True):
        path = (left, right, path)
    top = min(LEVELS, levels_above(nodes[0][4]))
    return head, _passed_down(_passed_up([(r[2], r[3]) for r in nodes], top), top, path)


def _unrolled(path) -> tuple[list[str], list[str]]:
    lefts, rights = [], []
    while path:
        lefts.append(path[0])
        rights.append(path[1])
        path = path[2]
    return lefts, rights


def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches, list(_MESSAGE)):
        head, nodes = _swept(rows)
        paths = [(index, *_unrolled(path)) for index, path, _ in nodes]
        texts = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([head[0]] * len(paths)), pa.array([p[0] for p in paths], pa.int64()), *(pa.array([p[k] for p in paths], texts) for k in (1, 2)), *(pa.array([head[k]] * len(paths), pa.string()) for k in (7, 8))],
            ["grp", "index", "lefts", "rights", "subroot", "root"],
        )


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches, [*_MESSAGE, "doc_id", "tampered"]):
        head, nodes = _swept(rows)
        own, out = {r[2]: r for r in rows[1:]}, []
        for index, path, proof in nodes:
            row = own[index]
            folded = row[10] or row[3]
            while path:
                folded, path = digest(path[0] + folded + path[1]), path[2]
            out.append((row[9], row[3], head[7], head[8], digest(proof), folded, folded == head[8]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


_PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _queue(messages: DataFrame) -> DataFrame:
    """Messages to the blocks, each block's in one task and by ascending label."""
    return messages.repartition("grp", "block").sortWithinPartitions("grp", "block", "index")


def _to_blocks(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("grp", F.floor(F.col("index") / BLOCK).alias("block"), "index", "digest", "n", *more)


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of each sweep's lowest nodes, and (grp, digest, last) of the trees' roots with the sweep that made them."""
    rounds, roots = [], None
    while True:
        rounds.append(nodes)
        seen = Observation()
        up = cut(_queue(_to_blocks(nodes)).mapInArrow(_upward, "grp string, index long, digest string, n long").observe(seen, F.max("n").alias("n")))
        done = up.filter("n = 1").select("grp", "digest", F.lit(len(rounds) - 1).alias("last"))
        roots = done if roots is None else roots.unionByName(done)
        if (seen.get["n"] or 1) <= 1:
            return rounds, roots
        nodes = up.filter("n > 1")


def _delivered(rounds: list[DataFrame], above: DataFrame, run, schema: str, *more: str) -> DataFrame:
    """The reversed sweep: `above` (grp, last, lefts, rights, subroot, root) goes to the roots, and down to the lowest nodes, of which `run` makes rows."""
    came = None
    for r in range(len(rounds) - 1, -1, -1):
        first = above.filter(F.col("last") == r).select("grp", F.lit(0).cast("long").alias("block"), "lefts", "rights", "subroot", "root")
        came = first if came is None else first.unionByName(came.withColumnRenamed("index", "block"))
        messages = _to_blocks(rounds[r], *(more if r == 0 else ())).unionByName(came.withColumn("index", F.lit(-1).cast("long")), allowMissingColumns=True)
        if r == 0:
            return _queue(messages).mapInArrow(run, schema)
        came = cut(_queue(messages).mapInArrow(_downward, f"grp string, index long, {_SUFFIX}"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents need doc_id, source, lang, n_chars and text; other columns are left alone. A null lang is a partition of its own and
    the first. Rows alike in lang and doc_id are ordered by their leaf, and a null doc_id comes first and is never tampered with; of rows
    alike in all that counts, any may be any of their leaves. Empty texts are values of 0 bytes, null ones are not. An empty table
    gives no rows.
    """
    leaves = cut(leaf_digests(docs))
    nodes = cut(ranked(leaves, ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest"))
    rounds, roots = grown(nodes)
    tops = cut(ranked(roots.withColumnsRenamed({"grp": "name", "last": "own_last"}).withColumn("grp", F.lit("")), ["name"]))
    top_rounds, top = grown(tops)
    none = F.array().cast("array<string>")
    above = top.select("grp", "last", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    to_groups = _delivered(top_rounds, above, _downward, f"grp string, index long, {_SUFFIX}").drop("grp", "subroot")
    suffixes = cut(tops.select(F.col("name").alias("grp"), F.col("own_last").alias("last"), F.col("digest").alias("subroot"), "index").join(to_groups, "index").drop("index"))
    return _delivered(rounds, suffixes, _proven, _PROVEN, "doc_id", "tampered")


def op11(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels of a tree that the SQL writes out: enough for 8^6 leaves.
_SQL_LEVELS = 6


def _sql() -> str:
    """The same with a query a level; the checksum goes bit by bit."""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    head = " || ".join(field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
    bit = "list_reduce(list_prepend({0}, [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(CAST(string_split(CAST(doc_id AS VARCHAR), '') AS VARCHAR[]), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: " + bit.format("xor(c, b)") + "), 4294967295)"
    ctes = [
        f"l0 AS (SELECT doc_id, lang, sha256({head} || {field('text')}) AS d, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lower)}) END AS tampered FROM documents)",
        "a0 AS (SELECT coalesce('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, * EXCLUDE (lang) FROM l0)",
    ]

    def tree(name: str) -> None:
        for k in range(_SQL_LEVELS):
            # a tree of one node stays as it is
            ctes.append(f"""{name}{k + 1} AS (SELECT grp, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN max(n) > 1 THEN CAST(ceil(max(n) / 8e0) AS BIGINT) ELSE 1 END AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY {name}{k}.i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY grp, n, CASE WHEN n > 1 THEN i // 8 ELSE i END)""")

    def siblings(name: str, k: int, at: str) -> tuple[str, str]:
        level = f"(SELECT string_agg(s.d, '' ORDER BY s.i) FROM {name}{k} s WHERE s.grp = {at}.grp AND s.n > 1 AND s.i // 8 = ({at}.i // {8 ** (k + 1)}) AND s.i {{}} {at}.i // {8**k})"
        return level.format("<"), level.format(">")

    def paths(name: str, out: str) -> None:
        parts, steps = [], []
        for k in range(_SQL_LEVELS):
            left, right = siblings(name, k, "x")
            parts += [f"coalesce({left}, '') AS l{k}", f"coalesce({right}, '') AS r{k}"]
            steps.append(f"(SELECT max(n) FROM {name}{k} s WHERE s.grp = x.grp) > 1 AS m{k}")
        ctes.append(f"{out} AS (SELECT x.*, {', '.join(parts)}, {', '.join(steps)} FROM {name}0 x)")

    def folded(d: str, step: str) -> str:
        return f"CASE WHEN m{step} THEN sha256(l{step} || {d} || r{step}) ELSE {d} END"

    def fold(source: str, out: str, start: str, result: str) -> None:
        ctes.append(f"{out}_0 AS (SELECT *, {start} AS f FROM {source})")
        for k in range(_SQL_LEVELS):
            ctes.append(f"{out}_{k + 1} AS (SELECT * EXCLUDE (f), {folded('f', str(k))} AS f FROM {out}_{k})")
        ctes.append(f"{out} AS (SELECT * EXCLUDE (f), f AS {result} FROM {out}_{_SQL_LEVELS})")

    tree("a")
    ctes.append(f"b0 AS (SELECT '' AS grp, grp AS name, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, d FROM a{_SQL_LEVELS})")
    tree("b")
    paths("a", "ap")
    paths("b", "bp")
    own = " || ".join(f"l{k} || r{k}" for k in range(_SQL_LEVELS))
    ctes.append(f"ap1 AS (SELECT *, {own} AS low FROM ap)")
    ctes.append(f"bp1 AS (SELECT *, {own} AS high FROM bp)")
    fold("ap1", "af", "coalesce(tampered, d)", "sub")
    renamed = ", ".join(f"b.{x}{k}" for k in range(_SQL_LEVELS) for x in "lrm")
    dropped = ", ".join(f"{x}{k}" for k in range(_SQL_LEVELS) for x in "lrm")
    ctes.append(f"j AS (SELECT a.* EXCLUDE ({dropped}), {renamed}, b.d AS subroot, b.high, (SELECT d FROM b{_SQL_LEVELS}) AS root FROM af a JOIN bp1 b ON a.grp = b.name)")
    fold("j", "jf", "sub", "folded_root")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, d AS leaf, subroot, root, sha256(low || high) AS proof_sha256, folded_root, folded_root = root AS verified FROM jf"


OP11_SQL = _sql()
