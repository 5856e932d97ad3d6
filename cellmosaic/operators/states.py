"""Mergeable states as values: a versioned binary form, and a table function that merges them in SQL.

A state is four bytes of mark, version and kind, then little-endian numbers: of statistics count, sum, sum of squared weights, least,
greatest and sum of squared deviations; of classes pairs of class and weight. States of two scans, of a stream's batches or of other
clusters are rows like others, and merge as one pass over all samples would have made them.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cellmosaic.operators import continuous

MARK, VERSION = b"CM", 1
KINDS = {"continuous": 1, "categorical": 2}
_NUMBERS = "<6d"
_PAIR = np.dtype([("category", "<i8"), ("weight", "<f8")])
FIELDS = ("count", "sum", "sum_w2", "min", "max", "m2")


def _head(kind: str) -> bytes:
    return MARK + bytes((VERSION, KINDS[kind]))


def opened(data: bytes, kind: str) -> memoryview:
    """What follows a state's head; another version or kind, or a cut state, is an error."""
    view = memoryview(data)
    if bytes(view[:2]) != MARK or len(view) < 4:
        raise ValueError("not a state: its mark is missing")
    if view[2] != VERSION:
        raise ValueError(f"a state of version {view[2]}; this is version {VERSION}")
    if view[3] != KINDS[kind]:
        raise ValueError(f"a state of kind {view[3]}, not {kind}")
    size = len(view) - 4
    if size != struct.calcsize(_NUMBERS) if kind == "continuous" else size % _PAIR.itemsize:
        raise ValueError("a state of the wrong length")
    return view[4:]


def encoded(states: DataFrame) -> DataFrame:
    """Columns of statistics' states (count, sum, sum_w2, min, max, m2) as one column `state`, null for an empty state."""

    @F.pandas_udf("binary")
    def pack(count: pd.Series, total: pd.Series, w2: pd.Series, low: pd.Series, high: pd.Series, m2: pd.Series) -> pd.Series:
        head, rows = _head("continuous"), np.stack([x.to_numpy(dtype=np.float64, na_value=np.nan) for x in (count, total, w2, low, high, m2)], axis=1).astype("<f8")
        return pd.Series([head + r.tobytes() if r[0] > 0 else None for r in rows], dtype=object)

    return states.withColumn("state", pack(*[F.col(c).cast("double") for c in FIELDS])).drop(*FIELDS)


def decoded(states: DataFrame) -> DataFrame:
    """The columns again; null states are left out."""

    @F.pandas_udf("struct<count double, sum double, sum_w2 double, min double, max double, m2 double>")
    def unpack(state: pd.Series) -> pd.DataFrame:
        rows = np.array([struct.unpack(_NUMBERS, opened(x, "continuous")) for x in state], dtype=np.float64).reshape(-1, len(FIELDS))
        return pd.DataFrame(rows, columns=list(FIELDS))

    return states.filter("state IS NOT NULL").withColumn("_s", unpack("state")).select(*[c for c in states.columns if c != "state"], "_s.*")


def encoded_classes(classes: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, category, weight) as a state a group, classes ascending."""

    @F.pandas_udf("binary")
    def pack(entries: pd.Series) -> pd.Series:
        return pd.Series([_head("categorical") + np.array([(e["category"], e["weight"]) for e in x], dtype=_PAIR).tobytes() for x in entries], dtype=object)

    return classes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("category", "weight"))).alias("_e")).select(*by, pack("_e").alias("state"))


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """Binary states of statistics merged by group with built-in aggregates."""
    return continuous.merge_states(decoded(states), by)


class _Statistics:
    """States of a group added one by one; one state is held, whatever their number."""

    def __init__(self):
        self.count = self.sum = self.sum_w2 = self.m2 = 0.0
        self.min, self.max = math.inf, -math.inf

    def add(self, data: bytes) -> None:
        n, s, w2, low, high, m2 = struct.unpack(_NUMBERS, opened(data, "continuous"))
        if n <= 0:
            return
        if self.count:
            apart = s / n - self.sum / self.count
            self.m2 += m2 + apart * apart * n * self.count / (n + self.count)
        else:
            self.m2 = m2
        self.count, self.sum, self.sum_w2 = self.count + n, self.sum + s, self.sum_w2 + w2
        self.min, self.max = min(self.min, low), max(self.max, high)

    def finished(self) -> dict[str, float]:
        under = self.count - self.sum_w2 / self.count
        deviation = math.sqrt(max(self.m2, 0.0) / under) if under > self.count * 1e-12 else 0.0
        return {"count": self.count, "sum": self.sum, "mean": self.sum / self.count, "stddev": deviation, "min": self.min, "max": self.max}


class _Classes:
    def __init__(self):
        self.count, self.weights = 0.0, {}

    def add(self, data: bytes) -> None:
        for category, weight in np.frombuffer(opened(data, "categorical"), _PAIR).tolist():
            self.weights[category] = self.weights.get(category, 0.0) + weight
            self.count += weight

    def finished(self) -> dict:
        top = max(self.weights.values())
        majority = min(c for c, w in self.weights.items() if w >= top - self.count * 1e-9)
        shares = [w / self.count for w in self.weights.values()]
        entropy = -sum(p * math.log(p) for p in shares) if len(shares) > 1 else 0.0
        return {"majority_class": majority, "majority_fraction": self.weights[majority] / self.count, "majority_count": self.weights[majority], "unique_classes": len(self.weights), "total_count": self.count, "shannon_entropy": entropy, "weights": dict(sorted(self.weights.items()))}


_COLUMNS = {
    "continuous": {c: DoubleType() for c in ("count", "sum", "mean", "stddev", "min", "max")},
    "categorical": {"majority_class": LongType(), "majority_fraction": DoubleType(), "majority_count": DoubleType(), "unique_classes": LongType(), "total_count": DoubleType(), "shannon_entropy": DoubleType(), "weights": MapType(LongType(), DoubleType())},
}


@dataclass
class _Plan(AnalyzeResult):
    """What the arguments ask for, for the tasks."""

    kind: str = "continuous"
    wanted: list = field(default_factory=list)
    limits: dict = field(default_factory=dict)
    keys: list = field(default_factory=list)


class MergeStates:
    """merge_cell_states(TABLE(states) PARTITION BY keys, kind => ..., columns => ...): finished cells, a row per partition.

    Output columns are the table's other than `state`, then those of the kind, or the ones listed. Null states are skipped; a partition
    of nothing else gives no row. Conditions: min_count, min_mean, max_mean for statistics, min_count and min_majority_fraction for
    classes; they are of merged cells.
    """

    def __init__(self, analyze_result: _Plan | None = None):
        self.plan = analyze_result
        self.first, self.state = None, None

    @staticmethod
    def analyze(states: AnalyzeArgument, kind: AnalyzeArgument | None = None, columns: AnalyzeArgument | None = None, min_count: AnalyzeArgument | None = None, min_mean: AnalyzeArgument | None = None, max_mean: AnalyzeArgument | None = None, min_majority_fraction: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not states.isTable or "state" not in states.dataType.names:
            raise ValueError("merge_cell_states needs a table with a column state")
        name = (kind.value if kind is not None else None) or "continuous"
        if name not in KINDS:
            raise ValueError(f"unknown kind {name!r}; one of {', '.join(KINDS)}")
        wanted = [c.strip() for c in columns.value.split(",")] if columns is not None and columns.value else list(_COLUMNS[name])
        if unknown := [c for c in wanted if c not in _COLUMNS[name]]:
            raise ValueError(f"{name} states have no {', '.join(unknown)}")
        limits = {k: float(v.value) for k, v in (("min_count", min_count), ("min_mean", min_mean), ("max_mean", max_mean), ("min_majority_fraction", min_majority_fraction)) if v is not None and v.value is not None}
        if misplaced := [k for k in limits if k in (("min_majority_fraction",) if name == "continuous" else ("min_mean", "max_mean"))]:
            raise ValueError(f"{name} states have no use for {', '.join(misplaced)}")
        keys = [f for f in states.dataType.fields if f.name != "state"]
        return _Plan(StructType([*keys, *[StructField(c, _COLUMNS[name][c]) for c in wanted]]), kind=name, wanted=wanted, limits=limits, keys=[f.name for f in keys])

    def eval(self, states, *_, **__):
        if self.first is None:
            self.first = [states[k] for k in self.plan.keys]
            self.state = _Statistics() if self.plan.kind == "continuous" else _Classes()
        if states["state"] is not None:
            self.state.add(bytes(states["state"]))

    def terminate(self) -> Iterator[tuple]:
        if self.state is None or not self.state.count:
            return
        found, limits = self.state.finished(), self.plan.limits
        ok = self.state.count >= limits.get("min_count", -math.inf)
        if self.plan.kind == "continuous":
            ok = ok and limits.get("min_mean", -math.inf) <= found["mean"] <= limits.get("max_mean", math.inf)
        else:
            ok = ok and found["majority_fraction"] >= limits.get("min_majority_fraction", -math.inf)
        if ok:
            yield (*self.first, *(found[c] for c in self.plan.wanted))


def register(spark: SparkSession) -> None:
    """merge_cell_states in SQL."""
    spark.udtf.register("merge_cell_states", F.udtf(MergeStates))


def is_state(value: Column, kind: str = "continuous") -> Column:
    """Whether a binary value has the head of a state of this version and kind."""
    return F.coalesce(F.substring(value, 1, 4) == F.lit(bytearray(_head(kind))), F.lit(False))
