"""Mergeable quantile sketches: logarithmic buckets of relative accuracy 1 %, as rows (group, rank key, weight)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.operators.pixels import finite

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
LN_GAMMA = math.log(GAMMA)
#: Values closer to zero count as zero: the least normal double.
TINY = 2.2250738585072014e-308


def bucket_of(value: Column) -> dict[str, Column]:
    """sign and key of a value's bucket; null if it isn't finite."""
    x = F.when(finite(value), value)
    return {"sign": F.when(F.abs(x) < TINY, 0).when(x > 0, 1).when(x < 0, -1), "key": F.when(F.abs(x) < TINY, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs(x)) / LN_GAMMA))}


def buckets(samples: DataFrame, by: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Sketch rows: sign, key and weight of each bucket, with the least and greatest value in it."""
    x, at = F.col(value), bucket_of(F.col(value))
    kept = samples.filter(finite(x))
    return kept.groupBy(*by, at["sign"].alias("sign"), at["key"].alias("key")).agg((F.sum(weight) if weight else F.count("*").cast("double")).alias("w"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "sign", "key").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def quantiles(sketch: DataFrame, by: list[str], targets: list[tuple[str, float | None]]) -> DataFrame:
    """A column per target: linear within the bucket that holds the rank, clamped to the group's extremes; iqr is p75 less p25."""
    order = F.col("sign") * (F.col("key") + 100_000)
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    rows = sketch.withColumns({"cum": F.sum("w").over(w), "total": F.sum("w").over(whole), "least": F.min("lo").over(whole), "most": F.max("hi").over(whole)})
    wanted = dict(targets)
    if None in wanted.values():
        wanted |= {"_p75": 0.75, "_p25": 0.25}
    out = []
    for name, q in wanted.items():
        if q is None:
            continue
        need = F.col("total") * q
        part = F.greatest(F.least((need - (F.col("cum") - F.col("w"))) / F.col("w"), F.lit(1.0)), F.lit(0.0))
        edge = F.exp(F.col("key") * LN_GAMMA)
        inside = F.when(F.col("sign") == 0, F.lit(0.0)).when(F.col("sign") > 0, edge * (1 + part * (GAMMA - 1))).otherwise(-edge * (GAMMA - part * (GAMMA - 1)))
        clamped = F.greatest(F.least(inside, F.col("most")), F.col("least"))
        out.append(F.min_by(F.when(F.col("cum") >= need * (1 - 1e-15), clamped), F.when(F.col("cum") >= need * (1 - 1e-15), order)).alias(name))
    found = rows.groupBy(*by).agg(*out)
    for name, q in targets:
        if q is None:
            found = found.withColumn(name, F.greatest(F.col("_p75") - F.col("_p25"), F.lit(0.0)))
    return found.drop("_p75", "_p25")
