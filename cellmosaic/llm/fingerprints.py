"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector and vectors are added modulo powers of
two: eight sums modulo 2^32 of hashes of the whole paragraph, which tell equal multisets, and 320 counts modulo 2^32, of how many of
the paragraph's pieces of four words have a hash bit set, from which likeness is estimated. Sums don't depend on order, and
adding or subtracting a paragraph's vector inserts or deletes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import cut

#: Words of the wide vector: two from each of these seeds.
SEEDS = (1, 2, 3, 4)
#: Words of a piece; hashes of a piece; bits of a count, of which two share a number: 64 counts a hash.
WORDS, HASHES, BITS = 4, 5, 32
#: Documents whose order one task finds, about.
ORDERED = 500_000
_LOW, _TWO = 0xFFFFFFFF, 1 | 1 << BITS


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def pieces(text: Column) -> Column:
    """Hashes of pieces of four words from the begin of each sentence of each paragraph on; the last may be shorter."""
    words = lambda p: F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(WORDS)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    return F.flatten(F.transform(F.filter(F.transform(F.split(text, r"[.!?][\x20\x09]+|\n"), words), lambda w: F.size(w) > 0), hashed))


def wide_sum(parts: Column) -> Column:
    """Eight sums modulo 2^32."""
    hashes = F.transform(parts, lambda p: F.array(*[F.xxhash64(F.lit(s), p) for s in SEEDS]))
    both = lambda h: [x for k in range(len(SEEDS)) for x in (h[k].bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h[k], 32))]
    zero = F.array(*[F.lit(0).cast("long")] * (2 * len(SEEDS)))
    return F.aggregate(hashes, zero, lambda a, h: F.array(*[(a[i] + x).bitwiseAND(F.lit(_LOW)) for i, x in enumerate(both(h))]))


def votes_by(rows: DataFrame, keys: list[str], text: str, name: str, copies: str | None = None) -> DataFrame:
    """(keys, name): the number of pieces of a text, then the counts of set hash bits, two to a number.

    Pieces become rows that an aggregation over built-in sums counts, partly before any shuffle. Rows alike in keys have the same
    text; if there may be several, `copies` names a column that tells how many.
    """
    carried = [*keys, *([copies] if copies else [])]
    out = rows.select(*carried, pieces(F.col(text)).alias("_p")).select(*carried, F.explode_outer("_p").alias("_h"))
    # a row for each hash, so that one aggregation has few enough sums to be generated code
    out = out.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(HASHES)])))
    out = out.withColumn("_x", F.when(F.col("_h").isNotNull(), F.when(F.col("_j") == 0, F.col("_h")).otherwise(F.xxhash64("_h", "_j"))))
    counts = [F.sum(F.shiftrightunsigned("_x", k).bitwiseAND(F.lit(_TWO))).alias(f"_v{k}") for k in range(BITS)]
    found = out.groupBy(*carried, "_j").agg(F.count("_x").alias("_n"), *counts)
    filled = F.array(*[F.coalesce(f"_v{k}", F.lit(0).cast("long")) for k in range(BITS)])
    whole = found.groupBy(*carried).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_j", filled.alias("v")))).alias("_parts"))
    every = F.concat(F.array("_n"), F.flatten(F.col("_parts.v")))
    # both counts in a number are multiples of the copies
    return whole.select(*keys, (F.transform(every, lambda x: F.call_function("div", x, F.col(copies))) if copies else every).alias(name))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Wide sums with the paragraphs of b inserted, or deleted for sign -1."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW)))


def add_votes(a: Column, b: Column, sign: int = 1) -> Column:
    """The same for counts."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _leanings(x: Column, n: Column) -> list[Column]:
    """Votes for less votes against of the two counts in a number, of n votes each."""
    return [2.0 * F.shiftrightunsigned(x, BITS * k).bitwiseAND(F.lit(_LOW)).cast("double") - n for k in range(2)]


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine (0 to 1) of two texts' multisets of pieces from their votes; 1 if these are equal, also if both are empty.

    The standard error is (1 - cosine^2) / sqrt(320): 0.056 at most.
    """

    def products(x: Column, y: Column) -> Column:
        u, v = _leanings(x, a[0]), _leanings(y, b[0])
        total = lambda p, q: p[0] * q[0] + p[1] * q[1]
        return F.struct(total(u, v).alias("ab"), total(u, u).alias("aa"), total(v, v).alias("bb"))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("ab", "aa", "bb")])
    sums = F.aggregate(
        F.zip_with(F.slice(a, 2, BITS * HASHES), F.slice(b, 2, BITS * HASHES), products), zero,
        lambda s, x: F.struct(*[(s[k] + x[k]).alias(k) for k in ("ab", "aa", "bb")]),
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["ab"] / F.sqrt(s["aa"] * s["bb"])))).otherwise(F.lit(0.0)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(sums)


def printed(wide: Column, votes: Column) -> Column:
    """The wide sums in hexadecimal, the number of pieces, and a hash of the counts."""
    return F.concat(F.array_join(F.transform(wide, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(":"), votes[0].cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64(votes))))


_KEY = ["id", "void", "text_key"]


def links(rows: DataFrame) -> DataFrame:
    """For each distinct document (id, void, text_key) how many copies it has, and the one before by descending id, as p_* with p_chars.

    The last comes before the first. Null ids (void) come last, documents alike in id are ordered by the hash of their text. Only keys
    and lengths are moved: they are range-sorted into parts, in each of which neighbours are found by a window; what lies
    beyond a part's edges comes from a table with one row per part.
    """
    seen = Observation()
    keys = cut(rows.groupBy(*_KEY).agg(F.max("n_chars").alias("chars"), F.count("*").alias("copies")).observe(seen, F.count("*").alias("n")))
    many = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen.get["n"] // ORDERED)
    spot = F.struct("void", F.bitwise_not("id").alias("down"), "text_key", "id", "chars")
    parts = cut(keys.select(*_KEY, "copies", spot.alias("spot")).repartitionByRange(many, "void", F.desc("id"), "text_key").withColumn("part", F.spark_partition_id()))
    by_part = Window.orderBy("part")  # one row per part
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("last").over(whole)
    edges = parts.groupBy("part").agg(F.max("spot").alias("last")).select("part", F.coalesce(F.lag("last").over(by_part), last).alias("before"))
    found = parts.withColumn("prior", F.lag("spot").over(Window.partitionBy("part").orderBy("spot"))).join(edges, "part")
    p = F.coalesce("prior", "before")
    return cut(found.select(*_KEY, "copies", *[p[k].alias(f"p_{k}") for k in _KEY], p["chars"].alias("p_chars")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("void"), F.xxhash64("text").alias("text_key"), "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, wide, votes, fingerprint; null texts count as empty, and an empty text has sums of 0."""
    rows = _keyed(docs, doc_id, text)
    copies = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"))
    votes = votes_by(rows.join(copies, _KEY), _KEY, "text", "votes", "copies")
    out = rows.withColumn("wide", wide_sum(paragraphs(F.col("text")))).join(votes, _KEY)
    return out.select(F.when(~F.col("void"), F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "wide", "votes", printed(F.col("wide"), F.col("votes")).alias("fingerprint"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside an edited text whose last third comes from the next document, by descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty, and
    null ids come last. Rows alike in id and text follow one another, and any of them may be the last of them; rows alike in
    id alone are ordered by a hash of the text, which is trusted to differ. A sole document is its own next one; an empty table
    gives no rows. Texts are shuffled once, by id and hash, and of each the first part that the one before needs once more.
    """
    rows = _keyed(docs, doc_id, text)
    order = links(rows.withColumn("n_chars", F.length("text").cast("long")))
    # texts are dealt by key once, and counts, heads and edited texts all read those shuffled files: counting thrice moves less
    # than counts that are shuffled on their own
    counted = votes_by(rows.hint("merge").join(order.select(*_KEY, "copies"), _KEY), _KEY, "text", "votes", "copies")
    placed = rows.hint("merge").join(order.drop("copies"), _KEY).hint("merge").join(counted, _KEY)
    placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY)))
    third = lambda chars: F.floor(chars / 3).cast("int")
    heads = placed.filter("copy = 1").select(F.col("p_id").alias("id"), F.col("p_void").alias("void"), F.col("p_text_key").alias("text_key"), F.substring("text", F.lit(1), third(F.col("p_chars"))).alias("head"), F.col("votes").alias("next_votes"))
    both = placed.select(*_KEY, "text", "votes", "copy").hint("merge").join(heads, _KEY)
    n, own = F.length("text"), F.col("copy") > 1  # of copies all but one come before a copy
    both = both.withColumns({"n_chars": n.cast("long"), "head": F.when(own, F.substring("text", F.lit(1), third(n))).otherwise(F.col("head")), "next_votes": F.when(own, F.col("votes")).otherwise(F.col("next_votes"))})
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third(n)), F.col("head")))
    # what is known of a row beside its edited text's counts, small enough to be the key of their aggregation
    both = both.withColumns({"wide": wide_sum(paragraphs(F.col("text"))), "edited_wide": wide_sum(paragraphs(F.col("edited"))), "edited_sha256": F.sha2("edited", 256), "near_next": likeness(F.col("votes"), F.col("next_votes"))})
    both = both.withColumn("fingerprint", printed(F.col("wide"), F.col("votes")))
    done = votes_by(both, [*_KEY, "copy", "n_chars", "edited_sha256", "fingerprint", "edited_wide", "near_next"], "edited", "edited_votes")
    done = done.hint("merge").join(counted, _KEY)
    return done.select(
        F.when(~F.col("void"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", printed(F.col("edited_wide"), F.col("edited_votes")).alias("edited_fingerprint"),
        likeness(F.col("votes"), F.col("edited_votes")).alias("near_edited"), "near_next",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
