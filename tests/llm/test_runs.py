"""Runs of words that occur again inside other lines, or broken at other places."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellmosaic.llm import paragraphs, runs

OP2 = {"least_words": 1, "passage_words": 20, "removed_words": 20, "run_words": paragraphs.RUN_WORDS}


def _line(rng, n):
    return " ".join("v%dé" % rng.randrange(50_000) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    texts, passages = {}, []
    for k in range(60):
        w = _line(rng, rng.choice([50, 51, 70, 120])).split()
        passages.append(" ".join(w))
        cut = rng.randrange(8, 40)
        inside = _line(rng, rng.randrange(1, 40)) + " " + " ".join(w) + " " + _line(rng, rng.randrange(1, 40))
        broken = " ".join(w[:cut]) + "\n" + " ".join(w[cut:]).upper().replace("É", "é")
        texts[2 * k] = "\n".join([_line(rng, 30), inside, _line(rng, 9)])
        texts[2 * k + 1] = "\n".join([_line(rng, 12), inside if k % 3 == 0 else _line(rng, 5) + " " + broken if k % 3 == 1 else " ".join(w), _line(rng, 25)])
    for k in range(200, 240):
        texts[k] = "\n".join(_line(rng, rng.randrange(1, 120)) for _ in range(4))
    return texts, passages


def test_every_planted_passage_is_found_and_nothing_else(table, planted):
    texts, passages = planted
    got = [r for r in paragraphs.repeated_paragraphs(table([(k, t, "a") for k, t in texts.items()]), **OP2).collect() if r["run"]]
    assert {r["doc_id"] for r in got} == set(range(120))
    words = lambda t: t.lower().split()
    for r in got:
        part = texts[r["doc_id"]][r["start"] :][: r["length"]]
        assert " ".join(words(part)) in passages[r["doc_id"] // 2] or r["doc_id"] % 6 in (0, 1)
        assert len(words(part)) >= 20 and texts[r["doc_id"]][: r["start"]].count("\n") == r["paragraph"] and part.count("\n") + 1 == r["lines"]
        assert r["keep_doc_id"] == r["doc_id"] // 2 * 2 and r["removed"] == bool(r["doc_id"] % 2) and r["copies"] == 2


def test_removed_runs_leave_the_rest(table):
    rng = random.Random(5)
    a, b, run, other = _line(rng, 12), _line(rng, 7), _line(rng, 60), _line(rng, 22)
    docs = table([(1, f"{a} {run}\n\n{b}", "s"), (2, f"{b} {b}\n{other} {run} {a}", "s"), (3, None, "s")])
    got = paragraphs.repeated_paragraphs(docs, **OP2)
    two = next(r for r in got.collect() if r["run"] and r["removed"])
    clean = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs, got).collect()}
    whole = f"{b} {b}\n{other} {run} {a}"
    assert clean[1] == f"{a} {run}\n\n{b}" and clean[3] is None
    assert clean[2] == whole[: two["start"]] + whole[two["start"] + two["length"] :] and two["length"] > len(run) // 2


def test_a_window_shared_is_an_anchor_shared():
    rng = random.Random(9)
    for _ in range(40):
        run = _line(rng, 45)
        raw = [f"{_line(rng, rng.randrange(0, 60))} {run} {_line(rng, rng.randrange(0, 60))}".encode() for _ in range(2)]
        sets = [set(runs.anchors(np.frombuffer(r, np.uint8), np.array([0, len(r)]), 20, 26)["h"].tolist()) for r in raw]
        assert sets[0] & sets[1]
    few = np.frombuffer(b"a b c " * 14 + b"d " * 2, np.uint8)
    assert len(runs.anchors(few, np.array([0, 40, len(few)]), 20, 26)) == 0


def test_only_sets_of_classes_asked_for_are_shuffled():
    """A text may have many paragraphs of which one meets another class."""
    rng = random.Random(4)
    text = "\n".join(_line(rng, 30) for _ in range(50))
    node = next(paragraphs._list(1, 20, 20)(iter([pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([0])], ["a", "b", "c", "d"])])))["node"][7].as_py()
    out = list(paragraphs._tokens(1, 20)(iter([pa.record_batch([pa.array([text]), pa.array([[node]], pa.list_(pa.int64()))], ["text", "asked"])])))
    assert [x for b in out for x in b["node"].to_pylist()] == [node]


def test_null_ids_copies_and_no_rows(table, empty):
    rng = random.Random(6)
    t = _line(rng, 90)
    got = paragraphs.repeated_paragraphs(table([(None, t + " x", "a"), (4, "y " + t, "a"), (4, "y " + t, "a")]), **OP2).filter("run").collect()
    assert {r["doc_id"] for r in got} == {None, 4} and {r["keep_doc_id"] for r in got} == {4}
    assert {(r["doc_id"], r["removed"]) for r in got} == {(None, True), (4, False), (4, True)}
    assert paragraphs.repeated_paragraphs(empty, **OP2).count() == 0
    once = paragraphs.repeated_paragraphs(table([(1, " ".join(["again and again"] * 40), "a")]), **OP2)
    assert once.filter(F.col("removed") & (F.col("length") < 10)).count() == 0


def test_text_of_one_word_is_few_rows(table):
    """In periodic text nearly each word begins an anchor."""
    got = paragraphs.repeated_paragraphs(table([(k, "x%d " % k + "the " * 400 + "y", "a") for k in range(3)]), **OP2).filter("run").collect()
    assert sorted((r["doc_id"], r["removed"]) for r in got) == [(0, False), (0, True), (1, True), (2, True)]
    assert all(r["length"] > 1500 for r in got if r["removed"])
