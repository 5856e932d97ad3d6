"""Corpus pipeline: stages over documents, each written and read again as the next one's input.

A stage's operator returns its decisions by document id and a hash of the text; the stage applies them to whole rows, so that
all columns of documents stay. Rows alike in both are the same document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm import exact_dedup, mixing, ngram_join, packing, quality
from cellmosaic.llm.common import scratch_dir


def _matched(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """docs joined with decisions (_id, _key, ...), one of each."""
    return docs.join(decisions, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_key")), how)


def _named(decisions: DataFrame, *more) -> DataFrame:
    return decisions.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), *more)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, scores at its threshold or more.

    Null and empty texts are scored like others; repeated rows stay repeated. Texts of any length are scored whole.
    """
    scores = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _matched(docs, _named(scores.filter("predicted = 1")), "left_semi")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as it stands, then of smallest id; null texts are empty ones.

    Rows that are alike in id and text count as copies too.
    """
    kept = exact_dedup.dedup_exact(docs).filter("kept")
    # a kept row may be repeated as a whole; nothing tells those apart, so such documents are taken once each
    one = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_key")).agg(F.count("*").alias("n")).filter("n > 1")
    out = _matched(docs, _named(kept), "left_semi")
    return out if one.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of similar texts; those without words are similar to none and stay.

    A null id is the smallest only in a component of null ids.
    """
    joined = ngram_join.join_ngrams(docs)
    return _matched(docs, _named(joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole, range-sorted by the training position of each copy.

    A copy that the mix cuts counts if at least half of it is taken. Only the copy at the end of a source's demand is cut, so a
    source's words differ from its target by at most half of that one document.
    """
    mixed = mixing.mix(docs)
    taken = F.arrays_zip(F.filter("copies", lambda words: words > 0).alias("words"), F.col("positions").alias("position"))
    whole = F.transform(F.filter(taken, lambda c: c["words"] * 2 >= F.col("size")), lambda c: c["position"])
    decided = _named(mixed, whole.alias("_at")).filter(F.size("_at") > 0)
    return _matched(docs, decided, "inner").withColumn("_at", F.explode("_at")).repartitionByRange("_at").sortWithinPartitions("_at").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; each copy of a document is packed on its own, and a null text is one piece of one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: The classifier, the similarity join and packing can't be said in SQL.
ORACLE_SQL = None
