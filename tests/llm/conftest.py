import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n int, sig string, score double, seed string, k int"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with the names of inner ones."""
    long = prose(1, 60_000, 5000)
    base = prose(2, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (None, "no id at all here today", "en", "a"), (3, long, "en", "a"), (4, base, "en", "a"), (4, base, "en", "a"),
        (5, near, "fr", "b"), (6, "one two", "de", "b"), (7, "one two", "de", "b"), (8, " \t\n ", "en", "b"), (9, base.upper(), "en", None), (10, long + " tail", None, "b"),
        (11, prose(3, 50), "es", "b"), (12, "\x00 odd é😀 <|im_end|> \\n", "en", "b"), (13, "x" * 200_000, "en", "b"),
    ]
    return spark.createDataFrame([(*r, 1, "x", 0.5, "y", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
