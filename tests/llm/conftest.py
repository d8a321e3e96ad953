import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, k string, rk string, component string"


def frame(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang) with further columns whose names clash with inner ones."""
    rows = [(*r, *[None] * (3 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z", "w") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, blanks, one character, a very long text, repeated rows, a null id, non-ASCII and equal texts but for white space."""
    long = words(30_000, 1)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, long), (6, long + " "), (7, "Hello, World."), (7, "Hello, World."), (8, "hello,  world."), (9, "ñandú straße 東京 🙂 x"),
        (10, "ñandú straße  東京 🙂 x"), (11, "é" * 3000), (12, "ab" * 700), (13, words(300, 2)), (14, words(300, 2) + " tail end here"), (15, "Hello, World."), (None, "Hello, World."), (16, "12 34 --"),
    ]
