"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Sequences hold a fixed number of tokens, so all that packing needs to know is how many pieces there are of each length: a
table of at most `capacity` rows, whatever the corpus. The plan is made from that table: the reduction fixes sets that
dominate every other choice, best-fit places the rest, both for whole runs of equal pieces at once. Spark then ranks pieces
within their length and looks each up in the plan's runs.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import cut

CAPACITY = 2048
#: Characters of text that are encoded at a time, or one longer text.
ENCODED = 1 << 20
#: Longest word whose ids a worker remembers, and how many it remembers before it forgets the later half of them.
WORD, WORDS = 48, 1_000_000


class Encoder:
    """Ids of texts, each followed by id 0, as little-endian unsigned 32-bit integers; no special tokens are added.

    The tokenizer encodes everything. If it is byte-level, it cuts texts wherever white space follows another character, around a
    line break between two others, and between a letter or digit and signs behind it, and encodes the parts on their own; so texts
    are cut there beforehand and the ids of parts that come again are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cutter = made["pre_tokenizer"] or {}
        spaced = any(not t["content"].isprintable() or " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
        self.cuts = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"] and made["normalizer"] is None and not spaced
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that begin with a space, as byte-level names them
        if self.cuts:
            self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
            self.line = np.frombuffer(self._encoded(["\n"])[0], dtype="<u4")
            self.signs = {c: self._encoded([c])[0] for c in ",.!?;:)"}
        self.known: dict[str, bytes] = {}  # ids of a word with a space in front
        self.first: dict[str, bytes] = {}  # and without

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= ENCODED):
                size += len(texts[j])
                j += 1
            for ids in self._cut(texts[i:j]) if self.cuts else self._encoded(texts[i:j]):
                yield np.frombuffer(ids + b"\0\0\0\0", dtype="<u4")
            i = j

    def _encoded(self, texts: list[str]) -> list[bytes]:
        # without offsets, which nothing here needs
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], between: str) -> Iterator[bytes]:
        """Parts encoded as one text. With a space in front and no other, a part's first token is its one that begins with a space;
        without white space they are put apart by line breaks."""
        for k in range(0, len(parts), 1000):
            some = parts[k : k + 1000]
            ids = np.frombuffer(self._encoded([between.join(some)])[0], dtype="<u4")
            marks = np.flatnonzero(self.begins[ids] if not between else ids == self.line[0])
            begin, end = (marks, np.r_[marks[1:], len(ids)]) if not between else (np.r_[0, marks + 1], np.r_[marks, len(ids)])
            if len(begin) != len(some):
                yield from self._encoded(some)
            else:
                raw = ids.tobytes()
                yield from map(raw.__getitem__, map(slice, (4 * begin).tolist(), (4 * end).tolist()))

    def _cut(self, texts: list[str]) -> Iterator[bytes]:
        """The same, part by part; a part begins with its space, but for the first of a line, and ends in what is no white space."""
        known, first, line_break = self.known, self.first, self.line.tobytes()
        rows: list[list] = []
        new: dict[str, bytes | None] = {}
        missing: list[tuple[list, int, str]] = []
        for text in texts:
            lines = text.split("\n")
            if len(lines) > 1 and not (all(map(_ends_well, lines)) and all(_ends_well(x[:1]) for x in lines[1:])):
                lines = [text]
            row: list = []
            for line in lines:
                if row:
                    row.append(line_break)
                words, at = line.split(" "), len(row)
                row += map(known.get, words)
                row[at], done = first.get(words[0]) if _ends_well(words[0]) else None, 0
                if None not in row[at:]:
                    continue
                for i in [i for i, x in enumerate(row[at:]) if x is None]:
                    if i < done:
                        continue
                    j, word = i, words[i]
                    while j + 1 < len(words) and not _ends_well(words[j]):
                        j += 1
                        row[at + j] = b""
                    if i != j:
                        word = " ".join(words[i : j + 1])
                    elif i and (ids := known.get(word[:-1])) and word[-1] in self.signs and word[-2] < "\u0250" and word[-2].isalnum():
                        row[at + i] = known[word] = ids + self.signs[word[-1]]
                        continue
                    word = " " + word if i else word
                    new[word] = None
                    missing.append((row, at + i, word))
                    done = j + 1
            rows.append(row)
        spaced = [x for x in new if x[:1] == " " and len(x) > 1 and x.isprintable() and " " not in x[1:]]
        bare = [x for x in new if x[:1] != " " and x and x.isprintable() and " " not in x]
        other = list(new.keys() - set(spaced) - set(bare))
        for some, ids in ((spaced, self._joined(spaced, "")), (bare, self._joined(bare, "\n")), (other, self._encoded(other))):
            new.update(zip(some, ids, strict=True))
        known.update((x[1:], new[x]) for x in spaced if len(x) <= WORD)
        first.update((x, new[x]) for x in bare if len(x) <= WORD)
        for row, i, word in missing:
            row[i] = new[word]
        yield from map(b"".join, rows)
        if len(known) + len(first) > WORDS:  # common words come early
            self.known, self.first = (dict(islice(d.items(), len(d) // 2)) for d in (known, first))


def _ends_well(word: str) -> bool:
    """Whether a word ends in what is surely not white space, so that a space behind it begins another part."""
    last = word[-1:]
    return "!" <= last <= "~" or (last > " " and last.isprintable())


_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids, then id 0. Only longer ones are cut, at multiples of the capacity from their end, so only the
    first piece may be shorter. Null texts are empty and give one piece of one token. tokenizer None: the public byte-level BPE.
    """
    if tokenizer is None:
        tokenizer = default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, x in zip(out, (key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, how many, first sequence, offset), and the number of sequences.

    A run puts as many pieces of one length, from that rank on, into consecutive sequences at that offset. Its size depends on
    the lengths that occur, not on how many pieces there are.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    lengths = sorted(left)  # those with pieces left, ascending
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(w: int, k: int, sequence: int, offset: int) -> None:
        runs.append((w, used[w], k, sequence, offset))
        used[w] += k
        left[w] -= k
        if not left[w]:
            del left[w]
            lengths.pop(bisect_left(lengths, w))

    def fix(members: list[int], k: int) -> None:
        nonlocal sequences
        at = 0
        for w in members:
            take(w, k, sequences, at)
            at += w
        sequences += k

    def fitting(room: int, *spoken_for: int) -> int | None:
        """Largest length of at most room with a piece left beside those spoken for."""
        i = bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= spoken_for.count(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else None

    def dominating(w: int) -> list[int] | None:
        """A set with one piece of length w that dominates every other set with it, if one is shown."""
        room = capacity - w
        best = fitting(room, w)
        if best is None:
            return [w]
        some = _smallest(lengths, left, 4)
        some.remove(w) if w in some else some.pop()  # the smallest three beside this piece
        if best == room or sum(some[:2]) > room:
            # a partner that fills it, or the largest where only one can join
            return [w, best]
        if sum(some) > room:
            # at most two can join; a best partner no smaller than any two, or two that any other two fit under
            if best >= _best_pair(lengths, left, room, 0):
                return [w, best]
            other = fitting(room - best, w, best)
            if other is not None and best >= _best_pair(lengths, left, room, other):
                return [w, best, other]
        return None

    for w in reversed(list(lengths)):
        while w in left and (members := dominating(w)):
            fix(members, min(left[x] // members.count(x) for x in members))

    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: sequences from a first one, how many
    open_rooms: list[int] = []
    while lengths:
        w = lengths[-1]
        i = bisect_left(open_rooms, w)
        if i == len(open_rooms):
            n = left[w]
            each = capacity // w
            if n >= each:
                k = n // each
                for j in range(each):
                    take(w, k, sequences, j * w)
            else:
                k, each = 1, n
                for j in range(each):
                    take(w, 1, sequences, j * w)
            first, room = sequences, capacity - each * w
            sequences += k
        else:
            room = open_rooms[i]
            first, size = rooms[room].pop()
            k = min(size, left[w])
            if k < size:
                rooms[room].append((first + k, size - k))
            if not rooms[room]:
                open_rooms.pop(i)
            take(w, k, first, capacity - room)
            room -= w
        if room:
            if not rooms[room]:
                insort(open_rooms, room)
            rooms[room].append((first, k))
    return runs, sequences


def _smallest(lengths: list[int], left: dict[int, int], n: int) -> list[float]:
    out: list[float] = []
    for w in lengths:
        out += [w] * min(left[w], n - len(out))
        if len(out) == n:
            return out
    return [float("inf")]


def _best_pair(lengths: list[int], left: dict[int, int], room: int, over: int) -> int:
    """The most that two pieces longer than `over` can fill of room; 0 if none can."""
    i, j, best = bisect_right(lengths, over), bisect_right(lengths, room) - 1, 0
    while i <= j:
        x, y = lengths[i], lengths[j]
        if x + y > room or (i == j and left[x] < 2):
            j -= 1
        else:
            best = max(best, x + y)
            i += 1
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), each of 1 to `capacity` tokens.

    Equal pieces rank by id and piece number; pieces alike in both are interchangeable. Ranks are running counts within
    buckets of ids plus the counts of earlier buckets, so that a length which a third of all pieces share is spread over many
    tasks. An empty table gives no rows.
    """
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    n = pieces.count()
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(max(16, n // 20_000 * 4))))
    per_bucket = cut(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per_bucket.select("length", "bucket", before.alias("base"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    schema = "length long, rank_from long, rank_to long, sequence_from long, offset long"
    plan = pieces.sparkSession.createDataFrame([(w, a, a + k, s, o) for w, a, k, s, o in runs], schema)
    # the plan's size is bounded by the capacity, not by the corpus
    found = ranked.join(F.broadcast(plan), "length").filter("rank >= rank_from and rank < rank_to")
    return found.withColumn("sequence_id", F.col("sequence_from") + F.col("rank") - F.col("rank_from")).drop("row", "bucket", "base", "rank", "rank_from", "rank_to", "sequence_from")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of the documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows are independent: null ids stay null, repeated rows are packed once each, null and empty texts are one piece of one
    token, other columns are not read, and an empty table gives no rows.
    """
    return pack(cut_pieces(docs, tokenizer, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
