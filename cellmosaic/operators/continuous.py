"""Weighted statistics per cell, their partial states, filters, compaction and output policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.operators.pixels import finite

#: What adds up of a partial state; M2 needs the counts and means too.
STATE = ("count", "sum", "sum_w2", "min", "max", "m2")


def deviation(m2: Column, weight: Column, weight2: Column) -> Column:
    """Standard deviation by reliability weights; 0 for one observation."""
    under = weight - weight2 / weight
    return F.when(under > weight * 1e-12, F.sqrt(F.greatest(m2, F.lit(0.0)) / F.when(under > weight * 1e-12, under))).otherwise(F.lit(0.0))


def unit_statistics(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, sum, mean, stddev, min and max of samples of weight 1: one aggregation of built-ins."""
    x = F.col(value)
    return samples.filter(finite(x)).groupBy(*by).agg(
        F.count("*").cast("double").alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max")
    )


def partial_states(samples: DataFrame, by: list[str], value: str = "value", weight: str | None = "weight") -> DataFrame:
    """A mergeable state per group; weight None: every sample weighs 1.

    M2 is Spark's own running variance among samples of equal weight, so nothing cancels whatever the mean; samples of the
    same group but other weights are states that are merged.
    """
    x = F.col(value)
    moments = [F.count("*").cast("double").alias("_n"), F.sum(x).alias("_s"), F.var_pop(x).alias("_v"), F.min(x).alias("min"), F.max(x).alias("max")]
    w = F.lit(1.0) if weight is None else F.col("_w")
    state = [(w * F.col("_n")).alias("count"), (w * F.col("_s")).alias("sum"), (w * w * F.col("_n")).alias("sum_w2"), "min", "max", (w * F.col("_n") * F.col("_v")).alias("m2")]
    if weight is None:
        return samples.filter(finite(x)).groupBy(*by).agg(*moments).select(*by, *state)
    kept = samples.filter(finite(x) & (F.col(weight) > 0)).withColumn("_w", F.col(weight).cast("double"))
    return merge_states(kept.groupBy(*by, "_w").agg(*moments).select(*by, *state), by)


def merge_states(states: DataFrame, by: list[str], salts: int = 1) -> DataFrame:
    """States of the same group in one, by Chan, Golub and LeVeque; null and empty states are skipped.

    What lies between states is taken about the merged mean, which a window over the group's states gives: one shuffle of states.
    Where a group may have very many, `salts` merges them in as many parts first, since merging merged states is the same.
    """
    if salts > 1:
        dealt = states.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
        states = merge_states(dealt, [*by, "_salt"]).drop("_salt")
    n, s = F.col("count"), F.col("sum")
    group = Window.partitionBy(*by)
    about = states.filter(n > 0).withColumn("_apart", s / n - F.sum(s).over(group) / F.sum(n).over(group))
    return about.groupBy(*by).agg(
        F.sum(n).alias("count"), F.sum(s).alias("sum"), F.sum("sum_w2").alias("sum_w2"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum(F.col("m2") + n * F.col("_apart") * F.col("_apart")).alias("m2")
    )


def finished(states: DataFrame) -> DataFrame:
    """mean and stddev in place of the moments."""
    return states.withColumns({"mean": F.col("sum") / F.col("count"), "stddev": deviation(F.col("m2"), F.col("count"), F.col("sum_w2"))}).drop("m2", "sum_w2")


def weighted_statistics(samples: DataFrame, by: list[str], value: str = "value", weight: str | None = "weight") -> DataFrame:
    return finished(partial_states(samples, by, value, weight))


def having(cells: DataFrame, min_count: float | None = None, min_mean: float | None = None, max_mean: float | None = None) -> DataFrame:
    """Filters on finished cells."""
    for column, bound, keep in (("count", min_count, lambda c, b: c >= b), ("mean", min_mean, lambda c, b: c >= b), ("mean", max_mean, lambda c, b: c <= b)):
        if bound is not None:
            cells = cells.filter(keep(F.col(column), bound))
    return cells


def emit_empty(cells: DataFrame, touched: DataFrame, by: list[str], substitute: float | None = None) -> DataFrame:
    """Adds cells of `touched` without a valid sample: count and sum 0, other statistics null or the substitute."""
    every = touched.select(*by).distinct().join(cells, by, "left")
    fill = F.lit(substitute).cast("double")
    return every.withColumns({"count": F.coalesce("count", F.lit(0.0)), "sum": F.coalesce("sum", F.lit(0.0)), **{c: F.coalesce(c, fill) for c in ("mean", "min", "max")}})


def rounded(value: Column, decimals: int) -> Column:
    """Half away from zero; as it is where scaling would leave the exact range."""
    scaled = value * 10.0**decimals
    return F.when(F.abs(scaled) >= 4.5e15, value).otherwise(F.signum(scaled) * F.floor(F.abs(scaled) + 0.5).cast("double") / 10.0**decimals)


def compacted(cells: DataFrame, parent: Column, siblings: int = 4) -> DataFrame:
    """Parents in place of complete sets of sibling states (cell, resolution, STATE), other cells as they are."""
    with_parent = cells.withColumn("parent", parent)
    full = with_parent.groupBy("parent").agg(F.count("*").alias("_k")).filter(F.col("_k") == siblings).select("parent")
    up = merge_states(with_parent.join(full, "parent").withColumnRenamed("cell", "_child"), ["parent", "resolution"]).withColumnRenamed("parent", "cell").withColumn("resolution", F.col("resolution") - 1)
    rest = with_parent.join(full, "parent", "left_anti").drop("parent")
    return rest.unionByName(up.select(*rest.columns))
