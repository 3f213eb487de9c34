import random

import pytest

WORDS = "the of and river stone light under morning quiet harbour seven green letters window carried slowly bread market".split()


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def sentence(rng):
    def make(n, words=WORDS):
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) as a table with the columns of ``documents``."""

    def make(rows, more=""):
        full = [(*(list(r) + [None] * 4)[:4], None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *[f"'clash' AS {name}" for name in more.split()])

    return make
