import random

import pytest


@pytest.fixture
def rng():
    return random.Random(3)


def awkward(spark, rows):
    """A table of (doc_id, text) with a null text, an empty one, a null id, repeated rows and clashing column names."""
    rows = [*rows, (900, None), (901, ""), (None, rows[0][1] if rows else "x y"), (902, " \t\n"), *rows[:1]]
    wide = [(i, t, "a", "b", 1, "c", "d") for i, t in rows]
    return rows, spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, kept string, slot string")


@pytest.fixture
def wide(spark):
    return lambda rows: awkward(spark, rows)
