"""Tables with every odd row, as fixtures that the tests import."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, `key` string, id string"


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names of our own."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    near = base.copy()
    near[60] = "changed"
    rows = [
        (1, " ".join(base), "en", "a", 500, "x", "k", "i"),
        (2, " ".join(base), "en", "a", 500, "x", "k", "i"),
        (3, " ".join(near).upper(), "en", "b", 500, None, "k", "i"),
        (4, None, None, None, None, None, None, None),
        (5, "", "en", "a", 0, None, None, None),
        (6, " \n\t ", "de", "c", 4, None, None, None),
        (None, " ".join(base), "en", None, 500, None, None, None),
        (7, "one", "en", "b", 3, None, None, None),
        (8, "one two", "en", "b", 7, None, None, None),
        (9, " ".join(sentence(rng, 30_000)), "fr", "c", 1, None, None, None),
        (10, "mail me.x@mail.example.com or +1 (743) 555-3824 é 8.8.8.8, 4111111111111111", "es", "c", 9, None, None, None),
        (11, " ".join(sentence(rng, 40)), "en", "a", 1, None, None, None),
        (11, " ".join(sentence(rng, 40)), "en", "a", 1, None, None, None),
        (12, "\U0001f600 " * 30, "en", "d", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
