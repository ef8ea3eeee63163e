import random

import pytest

SYLLABLES = "an re th on er ti ha es nd or wh en be of it".split()


@pytest.fixture
def prose():
    """A function that makes deterministic prose of so many words."""

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture
def docs(spark):
    """A function that makes a documents table, with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, meta int")

    return make
