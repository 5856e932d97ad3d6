"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Water-filling turns weights into a word target for each source. A curriculum is, for each source, a piecewise-linear density
over training time 0..1. Its integral times the target is the source's cumulative demand; a copy of a document that covers
words [c, c + size) of its source's endless stream belongs at the time when demand reaches c, so inverting the integral gives
its training position. Documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import cut

#: No document is taken more often than this.
MOST_EPOCHS = 3
#: Curriculum shapes, dealt to sources in turn: (time, density) knots, linear in between; only proportions matter.
CURRICULA = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows that one bucket of a source's stream should hold about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """Per source (source, source_size): adds place (by code point, null last), weight and target.

    Targets share the sum of all sizes by weight and stop at `most` times their source's size, the excess reshared by weight
    until none is above: a source is full if its limit per weight is under the level at which the rest is shared. Windows
    here run over one row per source, never over documents.
    """
    whole = Window.partitionBy(F.lit(1))
    by_place = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("place", F.row_number().over(by_place) - 1).withColumn("limit", F.col("source_size") * most)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1))
    # sources fill up in this order; level: the words per weight that the source and all after it could have
    by_turn = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = F.coalesce(F.sum("limit").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(whole) - before) / F.sum("weight").over(by_turn.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("turn", F.row_number().over(by_turn)).withColumn("level", level)
    rows = rows.withColumn("first_open", F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("turn"))).over(whole))
    open_level = F.max(F.when(F.col("turn") == F.col("first_open"), F.col("level"))).over(whole)
    full = F.col("first_open").isNull() | (F.col("turn") < F.col("first_open"))
    return rows.select("source", "place", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(open_level * F.col("weight")).alias("target"))


def invert_curriculum(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integrated density has reached `share` (0 to 1) of its whole."""
    areas = [(t1 - t0) * (d0 + d1) / 2 for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(knots[-1][0])
    steps = []
    for ((t0, d0), (t1, d1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        steps.append((done, area, t0, t1, d0, d1))
        done += area
    for done, area, t0, t1, d0, d1 in reversed(steps):
        need, slope = F.greatest(share * whole - done, F.lit(0.0)), (d1 - d0) / (t1 - t0)
        # d0*x + slope*x*x/2 = need, in the form that stays exact for a slope near zero
        root = F.sqrt(F.greatest(F.lit(d0 * d0) + need * (2 * slope), F.lit(0.0)))
        x = F.when(root + d0 > 0, 2 * need / (root + d0)).otherwise(F.lit(0.0))
        out = F.when(share * whole <= done + area, F.least(x + t0, F.lit(t1))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), curricula=CURRICULA, doc_id: str = "doc_id", source: str = "source", text: str = "text", most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document, range-sorted by its first position: doc_id, source, size, source_size, target, taken, copies, positions, first_position, text_key.

    A source's stream holds its documents by md5 of their id, over and over; the mix takes the first floor(target) words of
    it: a copy is taken if its source's demand reaches it, which gives it a training position, 0 to 1, in positions, and its words up to
    the end of the demand in copies. taken is their sum, so a source's taken words are its target rounded down. Null texts have size 0 and null ids come last in the stream; rows alike in id
    are ordered by size, and rows alike in both are interchangeable. Empty texts are never taken. An empty table gives no
    rows. Each stream's running sums come from sums of md5 buckets, so that a hot source is spread over many tasks.
    """
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_key")).withColumn("mark", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g"))))
    n = rows.count()
    buckets = min(1 << 16, max(256, n // BUCKET_ROWS * 4))
    # buckets keep md5's order: its first four digits are 0 to 65535, and null ids follow
    rows = rows.withColumn("bucket", F.when(F.col("mark") == "g", buckets).otherwise(F.floor(F.conv(F.substring("mark", 1, 4), 16, 10).cast("long") * buckets / 65536)).cast("long"))
    parts = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("part")))
    sources = cut(targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, most))
    earlier = Window.partitionBy("p.source").orderBy("p.bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(F.col("p.source").alias("source"), "bucket", "place", "source_size", "target", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("r").join(begun.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))).select("doc_id", "text_key", F.col("r.source").alias("source"), "size", "source_size", "target", "place", (F.col("at") + F.col("base")).alias("begin"))
    demand, each = F.floor(F.col("target")), F.sequence(F.lit(0), F.lit(most - 1))

    def when_reached(share: Column) -> Column:
        by_shape = [invert_curriculum(share, knots) for knots in curricula]
        out = by_shape[-1]
        for k in range(len(curricula) - 1):
            out = F.when(F.col("place") % len(curricula) == k, by_shape[k]).otherwise(out)
        return out

    begins = lambda k: F.col("begin") + k * F.col("source_size")
    reached = lambda k: F.when((F.col("size") > 0) & (begins(k) < demand), when_reached(begins(k) / demand))
    placed = placed.withColumn("times", F.transform(each, reached))
    words = lambda t, k: F.when(t.isNotNull(), F.least(F.col("size"), demand - begins(k))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("copies", F.transform("times", words)).withColumn("positions", F.array_compact("times"))
    placed = placed.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("first_position", F.try_element_at("positions", F.lit(1)))
    return placed.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", "first_position", "text_key")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy in training order: doc_id, source, copy, words, position."""
    copies = mixed.select("doc_id", "source", F.posexplode(F.arrays_zip(F.filter("copies", lambda w: w > 0).alias("words"), F.col("positions").alias("position"))).alias("copy", "c"))
    return copies.select("doc_id", "source", "copy", "c.words", "c.position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def op5(spark, sf_dir: str) -> DataFrame:
    """The mix, with the number of copies and the positions of the first and the last, to nine decimals."""
    nine = lambda x: F.floor(x * 1e9 + 0.50037) / 1e9
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), nine(F.col("first_position")).alias("first_position"), nine(F.try_element_at("positions", F.lit(-1))).alias("last_position"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST(1 + place % 3 AS DOUBLE) AS weight, source_size * 3 AS lim FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, place) AS turn FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT *, min(CASE WHEN lim > level * weight THEN turn END) OVER () AS first_open FROM l),
g AS (SELECT source, place, source_size, CASE WHEN first_open IS NULL OR turn < first_open THEN CAST(lim AS DOUBLE) ELSE max(CASE WHEN turn = first_open THEN level END) OVER () * weight END AS target FROM f),
b AS (SELECT d.doc_id, d.size, g.place, g.source_size, g.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY coalesce(md5(CAST(d.doc_id AS VARCHAR)), 'g'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (CASE WHEN at_word < floor(target) THEN 1 ELSE 0 END) + (CASE WHEN at_word + source_size < floor(target) THEN 1 ELSE 0 END) + (CASE WHEN at_word + 2 * source_size < floor(target) THEN 1 ELSE 0 END) END AS copies FROM b),
e AS (SELECT *, at_word / floor(target) AS share0, (at_word + (copies - 1) * source_size) / floor(target) AS share1 FROM c)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, floor(target) - at_word)) + greatest(0, least(size, floor(target) - at_word - source_size)) + greatest(0, least(size, floor(target) - at_word - 2 * source_size)) AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
  CASE WHEN copies > 0 THEN floor((CASE place % 3 WHEN 0 THEN share0 WHEN 1 THEN 1.5e0 - sqrt(2.25e0 - 2 * share0) ELSE sqrt(0.25e0 + 2 * share0) - 0.5e0 END) * 1e9 + 0.50037e0) / 1e9 END AS first_position,
  CASE WHEN copies > 0 THEN floor((CASE place % 3 WHEN 0 THEN share1 WHEN 1 THEN 1.5e0 - sqrt(2.25e0 - 2 * share1) ELSE sqrt(0.25e0 + 2 * share1) - 0.5e0 END) * 1e9 + 0.50037e0) / 1e9 END AS last_position FROM e
"""
