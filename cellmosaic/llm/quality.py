"""Quality classifier: a sparse rule ensemble over text statistics.

A forest grown on labelled rows proposes rules, each a conjunction of bounds on statistics along a path from a root; lasso
logistic regression keeps few of them, beside the clamped statistics themselves; what is left is compiled into one Spark
column expression. Statistics are computed from the whole text of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import LOWER, SPACE, code_points, cut, row_blocks, span_hashes, text_buffer, words

#: Most labelled rows that a model is fitted on; the rows of smallest id hash are taken.
MOST_TRAINING_ROWS = 20_000
#: A document is kept at this score.
THRESHOLD = 0.7

STATISTICS = (
    "log_points", "log_words", "word_mean", "word_longest", "words_distinct", "word_top_share", "adjacent_same", "shingles_repeated",
    "lines", "line_mean", "lines_repeated", "upper", "digit", "mark", "symbol", "bang", "non_ascii", "space",
    "end_marked", "bang_words", "capital_words", "shout_words", "short_words", "vowels",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_MARK, _SYMBOL = _table(b".,;:!?'\"()-"), _table(b"#$%&*+/<=>@[\\]^_`{|}~")
_VOWEL = _table(b"aeiouyAEIOUY")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    size, points = np.diff(at), code_points(raw, at)
    begin, end, first = words(raw, at)
    n = np.diff(first)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
    upper = _UPPER[raw]
    if len(raw) > 1:  # accented capitals of Latin-1
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)
    length = end - begin
    capitals = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(upper, out=capitals[1:])
    letters = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(upper | ((raw >= 97) & (raw < 123)), out=letters[1:])
    head = np.zeros(len(begin), dtype=bool)
    ended = np.zeros(len(begin), dtype=bool)
    bang = np.zeros(len(begin), dtype=bool)
    if len(begin):
        lead = np.where((raw[begin] == 0xC3) & (length > 1), begin + 1, begin)
        head, last = upper[lead], raw[end - 1]
        ended, bang = (last == 46) | (last == 33) | (last == 63), last == 33
    shout = (capitals[end] - capitals[begin] >= 2) & (capitals[end] - capitals[begin] == letters[end] - letters[begin])
    hashed = span_hashes(LOWER[raw], begin, end)
    same = np.zeros(len(hashed), dtype=bool)
    same[1:] = hashed[1:] == hashed[:-1]
    same[first[:-1][n > 0]] = False  # a text's first word has none before it
    lines = _sums(raw == 10, at)
    out = np.zeros((len(size), len(STATISTICS)))
    distinct, top, repeated, longest, twice = (np.zeros(len(size)) for _ in range(5))
    for r in range(len(size)):
        a, b = first[r], first[r + 1]
        if a == b:
            continue
        _, c = np.unique(hashed[a:b], return_counts=True)
        distinct[r], top[r], longest[r] = len(c), c.max(), length[a:b].max()
        if b - a >= 6:
            three = hashed[a : b - 2] * np.uint64(3) + hashed[a + 1 : b - 1] * np.uint64(5) + hashed[a + 2 : b] * np.uint64(7)
            repeated[r] = 1 - len(np.unique(three)) / len(three)
        if lines[r]:
            split = raw[at[r] : at[r + 1]].tobytes().split(b"\n")
            twice[r] = 1 - len(set(split)) / len(split)
    columns = (
        np.log1p(points), np.log1p(n), _sums(~SPACE[raw], at) * per_word, longest, distinct * per_word, top * per_word, np.add.reduceat(np.r_[same, False], np.minimum(first[:-1], len(same))) * (n > 0) * per_word, repeated,
        lines, size / (lines + 1), twice, _sums(upper, at) * per_byte, _sums(_DIGIT[raw], at) * per_byte, _sums(_MARK[raw], at) * per_byte, _sums(_SYMBOL[raw], at) * per_byte, _sums(raw == 33, at) * per_byte, _sums(raw >= 128, at) * per_byte, _sums(SPACE[raw], at) * per_byte,
    )
    by_word = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][first]) * per_word
    columns += (by_word(ended), by_word(bang), by_word(head), by_word(shout), by_word(length <= 2), _sums(_VOWEL[raw], at) * per_byte)
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and the STATISTICS of each whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(2))
            blocks = [statistics(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in row_blocks(at)]
            table = np.concatenate(blocks) if blocks else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], ["doc_id", "text_key", *STATISTICS])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, over, at most) that all hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, most in self.bounds:
            out &= (F.col(name) > over) if over > -np.inf else F.lit(True)
            out &= (F.col(name) <= most) if most < np.inf else F.lit(True)
        return out


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # statistic, least, most, weight

    def score(self) -> Column:
        """Probability of label 1, over the columns STATISTICS."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin += F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        for name, least, most, weight in self.linear:
            margin += F.greatest(F.least(F.col(name), F.lit(most)), F.lit(least)) * weight
        return 1 / (1 + F.exp(-margin))


def tree_rules(description: str) -> list[Rule]:
    """A rule for each node under a root, read from a tree's printed form."""
    found, path = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, side, value in path:
            over, most = bounds.get(name, (-np.inf, np.inf))
            bounds[name] = (max(over, value), most) if side == ">" else (over, min(most, value))
        found.append(Rule(tuple((name, *b) for name, b in sorted(bounds.items()))))
    return found


def fit(labelled: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Fit on rows with STATISTICS and label 0 or 1. With one class only the score is that class, with no rows 0.5."""
    seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return RuleEnsemble({0: -20.0, 1: 20.0}[next(iter(seen))] if seen else 0.0)
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    ends = labelled.approxQuantile(list(STATISTICS), [0.025, 0.975], 0.001)
    linear = [(s, lo, hi) for s, (lo, hi) in zip(STATISTICS, ends, strict=True) if hi > lo]
    inputs = [r.column().cast("double") for r in rules] + [F.greatest(F.least(F.col(s), F.lit(hi)), F.lit(lo)) for s, lo, hi in linear]
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(labelled.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*inputs)).alias("features")))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights[: len(rules)], strict=True) if w], [(*x, float(w)) for x, w in zip(linear, weights[len(rules) :], strict=True) if w])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, text_key, held_out, score, predicted.

    Scores come from whole texts alone; empty and null texts have statistics of 0 and get a score like others. Labels of held-out rows, and
    null labels, are not used; of the rest at most `most_rows` are, those of smallest id hash. Repeated ids are scored
    each by their own text, null ids too. An empty table gives no rows.
    """
    table = cut(with_statistics(docs, doc_id, text))
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter(~held_out())
    training = cut(table.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "log_points").limit(most_rows).drop("doc_id", "text_key").coalesce(1))
    scored = table.select("doc_id", "text_key", held_out().alias("held_out"), fit(training).score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")

