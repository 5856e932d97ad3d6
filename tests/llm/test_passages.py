"""Paragraphs of few words, and passages that are broken into short lines."""

from __future__ import annotations

import random

import numpy as np

from cellmosaic.llm import paragraphs

WHOLE = {"least_words": 1, "passage_words": 20, "removed_words": 20}


def texts():
    rng = random.Random(8)
    line = lambda n: " ".join("v%d" % rng.randrange(5000) for _ in range(n))
    broken, flat = [line(10) for _ in range(6)], line(24)
    halves = " ".join(flat.split()[:12]) + "\n" + " ".join(flat.split()[12:])
    return {
        1: "\n".join([line(30), "all rights reserved by the nine of us here", line(7), *broken, line(9)]),
        2: "\n".join([line(8), line(11), *broken[:3], "", *broken[3:], line(30), "all rights reserved by the nine of us here"]),
        3: "\n".join([line(40), "Yes", flat]),
        4: "\n".join(["Yes", line(25), halves, line(33)]),
        5: "\n".join([line(25), "once", line(19), "alone", line(28)]),  # overlaps itself only
        6: "\n".join(["again and again and so on"] * 12),
    }


def test_lines_and_passages():
    for text in texts().values():
        raw = np.frombuffer(text.encode(), np.uint8)
        got = sorted(zip(*(x.tolist() for x in paragraphs.lines(raw, np.array([0, len(raw)]), 1, 20)), strict=True))
        parts, want, at = text.split("\n"), [], 0
        for k, part in enumerate(parts):
            n = len(part.split())
            if n:
                want.append((at, at + len(part), 0, k, 1, n))
            j = k
            while 0 < n < 20 and (j := j + 1) < len(parts):
                more = len(parts[j].split())
                n = n + more if more < 20 else 0
                if n >= 20:
                    want.append((at, at + len("\n".join(parts[k : j + 1])), 0, k, j - k + 1, n))
            at += len(part) + 1
        assert got == sorted(want)


def test_short_lines_and_broken_passages(table):
    docs = table([(k, t, "a") for k, t in texts().items()])
    got = paragraphs.repeated_paragraphs(docs, **WHOLE)
    rows = got.collect()
    at = {(r["doc_id"], r["paragraph"], r["lines"]): r for r in rows}
    assert at[1, 1, 1]["cluster_id"] == at[2, 10, 1]["cluster_id"] and not at[2, 10, 1]["removed"]
    assert at[3, 1, 1]["cluster_id"] == at[4, 0, 1]["cluster_id"]
    assert at[3, 2, 1]["cluster_id"] == at[4, 2, 2]["cluster_id"] and at[4, 2, 2]["removed"]
    assert {k[1] for k, r in at.items() if k[0] == 2 and r["removed"]} == {2, 3, 4, 6, 7}
    assert not [k for k in at if k[0] == 5]
    for (i, k, n), r in at.items():
        assert texts()[i][r["start"] :][: r["length"]] == "\n".join(texts()[i].split("\n")[k : k + n])
    clean = {r["doc_id"]: r["text"].split("\n") for r in paragraphs.without_repeats(docs, got).collect()}
    whole = {k: t.split("\n") for k, t in texts().items()}
    assert clean[1] == whole[1] and clean[2] == [*whole[2][:2], *whole[2][9:]] and clean[3] == whole[3] and clean[4] == [*whole[4][:2], whole[4][4]] and clean[5] == whole[5]
    assert clean[6] == whole[6][:4]


def test_op2_takes_all_lines(spark, table, tmp_path):
    table([(k, t, "a") for k, t in texts().items()]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["paragraph"]) for r in paragraphs.op2(spark, str(tmp_path)).collect()}
    assert {(1, 1), (2, 10), (3, 1), (4, 0), (4, 2), *((1, k) for k in range(3, 9)), *((2, k) for k in (2, 3, 4, 6, 7, 8))} <= got
