from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents with an extra column whose name could clash."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), i) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row long")

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Null and repeated ids, null and empty texts, ties, repeated rows, a very long text."""
    long = "word " * 60_000
    return table([(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one two", "b"), (5, "one  two", "b"), (5, "one  two", "b"), (None, "onetwo", "b"), (None, None, None), (7, long, "c"), (8, long + "x", "c"), (9, "é ünï " * 40, "d"), (9, "another text", "d")])


@pytest.fixture(scope="session")
def empty(table):
    return table([])
