"""The pipeline's stages on small documents, and its queries on the smallest tables."""

from __future__ import annotations

import random

import duckdb

import corpus_pipeline
from cellmosaic.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_apply_decisions(spark, table):
    rng = random.Random(4)
    line = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    texts = [line(60) for _ in range(30)]
    near = texts[0].split()
    near[30] = "changed"
    docs = table([(k, t, "s%d" % (k % 2)) for k, t in enumerate([*texts, texts[3], texts[3] + " ", " ".join(near)])])
    once = corpus_pipeline.drop_copies(spark, docs, SF)
    ids = {r["doc_id"] for r in once.collect()}
    assert ids == set(range(33)) - {3, 30} and once.columns == docs.columns
    apart = corpus_pipeline.drop_near_copies(spark, once, SF)
    assert {r["doc_id"] for r in apart.collect()} == ids - {32} and apart.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, apart, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= ids
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    assert packed.filter("piece = 0").count() == mixed.count()


def test_repeated_rows_stay_once(spark, table):
    docs = table([(1, "a b", "s"), (1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()) == [1, 3]


def test_empty_documents_pass_all_stages(spark, table):
    docs = table([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("offset + length > 2048").isEmpty()


def test_same_as_sql(spark):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    # whole numbers beside nulls come as floating from one side or the other
    alike = lambda df: df.sort_values("doc_id").reset_index(drop=True).apply(lambda c: c.astype("Float64") if c.dtype.kind in "iuf" else c).astype(str)
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF).toPandas()
        want = con.execute(sql).df()[list(got.columns)]
        assert alike(got).equals(alike(want)), name
