"""States as binary values, their merge in SQL, and roll-ups in several steps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellmosaic.operators import categorical, continuous, states


def weighted(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(c), float(v), float(w), int(k)) for c, v, w, k in zip(rng.integers(0, 6, 900), rng.normal(1e6, 9, 900), rng.choice((0.25, 1.0), 900), rng.integers(0, 4, 900), strict=True)]
    return spark.createDataFrame(rows, "cell long, value double, weight double, part int")


def test_states_of_two_scans_merge_in_sql(spark):
    states.register(spark)
    s = weighted(spark)
    half = lambda p: states.encoded(continuous.partial_states(s.filter(F.pmod("part", F.lit(2)) == p), ["cell"]))
    empty = spark.createDataFrame([(2, None), (99, None)], "cell long, state binary")
    half(0).unionByName(half(1)).unionByName(empty).createOrReplaceTempView("cell_states")
    got = {r["cell"]: r for r in spark.sql("SELECT * FROM merge_cell_states(TABLE(SELECT * FROM cell_states) PARTITION BY cell)").collect()}
    want = {r["cell"]: r for r in continuous.weighted_statistics(s, ["cell"]).collect()}
    other = {r["cell"]: r for r in continuous.finished(states.merged(spark.table("cell_states"), ["cell"])).collect()}
    assert got.keys() == want.keys() == other.keys() and 99 not in got
    for c in want:
        for k in ("count", "sum", "mean", "stddev", "min", "max"):
            assert got[c][k] == pytest.approx(want[c][k], rel=1e-9) == other[c][k]
    few = spark.sql("SELECT * FROM merge_cell_states(TABLE(SELECT * FROM cell_states) PARTITION BY cell, columns => 'mean,count', min_count => 100.0, max_mean => 1e7)")
    assert few.columns == ["cell", "mean", "count"] and {r["cell"] for r in few.collect()} == {c for c, r in want.items() if r["count"] >= 100}


def test_classes_merge_in_sql(spark):
    states.register(spark)
    s = weighted(spark).withColumn("cls", F.pmod(F.floor("value"), F.lit(5)))
    each = categorical.class_weights(s, ["cell", "part"], weight="weight")
    states.encoded_classes(each, ["cell", "part"]).drop("part").createOrReplaceTempView("class_states")
    got = {r["cell"]: r for r in spark.sql("SELECT * FROM merge_cell_states(TABLE(SELECT * FROM class_states) PARTITION BY cell, kind => 'categorical')").collect()}
    want = {r["cell"]: r for r in categorical.summary(categorical.class_weights(s, ["cell"], weight="weight"), ["cell"]).collect()}
    assert got.keys() == want.keys()
    for c, r in want.items():
        assert (got[c]["majority_class"], got[c]["unique_classes"]) == (r["majority_class"], r["unique_classes"]) and got[c]["shannon_entropy"] == pytest.approx(r["shannon_entropy"])
        assert sum(got[c]["weights"].values()) == pytest.approx(r["total_count"])


def test_foreign_states_are_errors(spark):
    states.register(spark)
    good = states.encoded(continuous.partial_states(weighted(spark), ["cell"])).first()["state"]
    assert states.opened(bytes(good), "continuous").nbytes == 48
    for bad in (b"", b"XX\x01\x01" + bytes(48), bytes(good[:2]) + b"\x02" + bytes(good[3:]), bytes(good[:-1]), states._head("categorical") + bytes(16)):
        with pytest.raises(ValueError):
            states.opened(bad, "continuous")
    spark.createDataFrame([(1, bytearray(b"nonsense"))], "cell long, state binary").createOrReplaceTempView("bad_states")
    with pytest.raises(PySparkException, match="mark is missing"):
        spark.sql("SELECT * FROM merge_cell_states(TABLE(SELECT * FROM bad_states) PARTITION BY cell)").collect()
    for call, why in (("columns => 'median'", "no median"), ("kind => 'x'", "unknown kind"), ("min_majority_fraction => 0.5", "no use for")):
        with pytest.raises(PySparkException, match=why):
            spark.sql(f"SELECT * FROM merge_cell_states(TABLE(SELECT * FROM bad_states) PARTITION BY cell, {call})")
    assert [r[0] for r in spark.createDataFrame([(good,), (bytearray(b"CM"),), (None,)], "s binary").select(states.is_state(F.col("s"))).collect()] == [True, False, False]


def test_a_cell_with_many_states(spark):
    """States of one cell are merged by salt first: no task sorts more than its share."""
    rows = spark.range(300_000).select(F.lit(5).cast("long").alias("cell"), F.lit(1.0).alias("count"), (F.col("id") % 10 + 1e9).alias("sum"), F.lit(1.0).alias("sum_w2"), (F.col("id") % 10 + 1e9).alias("min"), (F.col("id") % 10 + 1e9).alias("max"), F.lit(0.0).alias("m2"))
    got = continuous.finished(continuous.merge_states(rows, ["cell"], salts=16)).first()
    assert got["count"] == 300_000 and got["mean"] == pytest.approx(1e9 + 4.5) and got["stddev"] == pytest.approx(np.sqrt(8.25 * 300_000 / 299_999), rel=1e-6)
