"""Class weights per cell: majority, entropy, histograms, long and wide layouts, remapping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROP = {"null", "none", "nodata", "drop", "skip"}
_ELSE = {"else", "default", "*", "_"}


def parse_remap(spec: str) -> tuple[list[tuple[int, int, int | None]], tuple[bool, int | None]]:
    """Rules (low, high, target or None to drop), and whether other classes are mapped and to what.

    Entries 'source: target' are parted by commas or semicolons; a source is a class, a range a..b, a..=b or a-b, or a list in
    brackets; => and -> do for the colon.
    """
    body = spec.strip()
    if (body[:1], body[-1:]) in (("{", "}"), ("[", "]")):
        body = body[1:-1]
    rules, other = [], (False, None)
    for entry in filter(None, (e.strip() for e in re.split(r"[,;](?![^\[]*\])", body))):
        m = re.fullmatch(r"(.+?)\s*(?:=>|->|:)\s*(.+)", entry)
        if not m:
            raise ValueError(f"remap entry without target: {entry!r}")
        source, target = m[1].strip(" '\""), m[2].strip(" '\"").lower()
        to = None if target in _DROP else int(target)
        if source.lower() in _ELSE:
            other = (True, to)
            continue
        for part in re.split(r"\s*,\s*", source.strip("[] ")):
            if r := re.fullmatch(r"(-?\d+)\s*(?:\.\.=?|-)\s*(-?\d+)", part):
                rules.append((int(r[1]), int(r[2]), to))
            else:
                rules.append((int(part), int(part), to))
    if not rules and not other[0]:
        raise ValueError("remap needs entries")
    return rules, other


def remapped(cls: Column, spec: str) -> Column:
    """Exact sources win over ranges, then the first range; null is dropped; classes without a rule pass unless there is an else."""
    rules, (mapped, target) = parse_remap(spec)
    out = F.lit(None)
    first = True
    exact = {a: t for a, b, t in reversed(rules) if a == b}
    for low, high, to in [(k, k, t) for k, t in exact.items()] + [r for r in rules if r[0] != r[1]]:
        test = cls == low if low == high else cls.between(low, high)
        out = F.when(test, F.lit(to).cast("long")) if first else out.when(test, F.lit(to).cast("long"))
        first = False
    rest = F.lit(target).cast("long") if mapped else cls
    return rest if first else out.otherwise(rest)


def class_weights(samples: DataFrame, by: list[str], cls: str = "cls", weight: str | None = None) -> DataFrame:
    """One row per group and class with its weight."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    return samples.filter(F.col(cls).isNotNull()).groupBy(*by, F.col(cls).alias("category")).agg(w.alias("weight"))


def summary(classes: DataFrame, by: list[str]) -> DataFrame:
    """Per group: majority_class, majority_fraction, majority_count, unique_classes, total_count, shannon_entropy, histogram text.

    Classes within a billionth of the total of the most are tied, and the lowest of them is the majority.
    """
    entry = F.struct("category", "weight")
    gathered = classes.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sum("weight").alias("total_count"), F.max("weight").alias("top"))
    tied = F.filter("e", lambda x: x["weight"] >= F.col("top") - F.col("total_count") * 1e-9)
    share = lambda x: x["weight"] / F.col("total_count")
    entropy = F.aggregate("e", F.lit(0.0), lambda a, x: a - share(x) * F.log(share(x)))
    text = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), x["category"].cast("string"), F.lit('": '), F.format_string("%.4f", F.floor(share(x) * 1e4 + 0.5) / 1e4))), ", "), F.lit("}"))
    return gathered.withColumn("m", F.element_at(tied, 1)).select(
        *by, F.col("m.category").alias("majority_class"), (F.col("m.weight") / F.col("total_count")).alias("majority_fraction"), F.col("m.weight").alias("majority_count"), F.size("e").cast("long").alias("unique_classes"), "total_count",
        F.when(F.size("e") > 1, entropy).otherwise(F.lit(0.0)).alias("shannon_entropy"), text.alias("histogram"),
    )


def long_layout(classes: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and class: category, count, fraction, total_count, shannon_entropy, unique_classes."""
    totals = classes.groupBy(*by).agg(F.sum("weight").alias("total_count"), F.count("*").alias("unique_classes"), F.sum(F.col("weight") * F.log("weight")).alias("_wl"))
    # -sum(p ln p) = ln T - sum(w ln w) / T
    totals = totals.withColumn("shannon_entropy", F.when(F.col("unique_classes") > 1, F.log("total_count") - F.col("_wl") / F.col("total_count")).otherwise(F.lit(0.0))).drop("_wl")
    return classes.join(totals, by).select(*by, "category", F.col("weight").alias("count"), (F.col("weight") / F.col("total_count")).alias("fraction"), "total_count", "shannon_entropy", "unique_classes")


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the bin that holds the value, the last one closed; null outside."""
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:-1]]), lambda e: e <= value)) if len(edges) > 2 else F.lit(0)
    return F.when((value >= edges[0]) & (value <= edges[-1]), at.cast("long"))


def dense_bins(classes: DataFrame, by: list[str], edges: list[float], normalize: str = "none") -> DataFrame:
    """Every bin of every group that has one: bin, lower, upper, weight (or its fraction, or that per unit of value)."""
    totals = classes.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("category", "weight"))).alias("m"), F.sum("weight").alias("total"))
    bins = F.array(*[F.struct(F.lit(k).cast("long").alias("bin"), F.lit(a).alias("lower"), F.lit(b).alias("upper")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    rows = totals.select(*by, "total", "m", F.explode(bins).alias("b")).select(*by, "b.*", "total", F.coalesce(F.try_element_at("m", F.col("b.bin")), F.lit(0.0)).alias("weight"))
    if normalize == "fraction":
        rows = rows.withColumn("weight", F.col("weight") / F.col("total"))
    elif normalize == "density":
        rows = rows.withColumn("weight", F.col("weight") / F.col("total") / (F.col("upper") - F.col("lower")))
    elif normalize != "none":
        raise ValueError(f"unknown normalization {normalize!r}")
    return rows.drop("total")


def values_json(classes: DataFrame, by: list[str], normalize: str = "none") -> DataFrame:
    """A text per group of the classes seen, ascending: {"value":weight,...}."""
    total = F.sum("weight")
    found = classes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("category", "weight"))).alias("e"), total.alias("t"))
    if normalize not in ("none", "fraction"):
        raise ValueError(f"classes have no {normalize}")
    own = (lambda x: x["weight"] / F.col("t")) if normalize == "fraction" else (lambda x: x["weight"])
    text = F.transform("e", lambda x: F.concat(F.lit('"'), x["category"].cast("string"), F.lit('":'), number(own(x))))
    return found.select(*by, F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("histogram"))


def bins_json(bins: DataFrame, by: list[str]) -> DataFrame:
    """A text per group of dense_bins' rows: [[lower,upper,weight],...]."""
    found = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "lower", "upper", "weight"))).alias("e"))
    text = F.transform("e", lambda x: F.concat(F.lit("["), number(x["lower"]), F.lit(","), number(x["upper"]), F.lit(","), number(x["weight"]), F.lit("]")))
    return found.select(*by, F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("histogram"))


def number(x: Column) -> Column:
    """Shortest text of a number; whole ones without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))
