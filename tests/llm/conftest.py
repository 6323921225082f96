import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def prose():
    def make(seed, n):
        return " ".join(random.Random(seed).choices(WORDS, k=n))

    return make


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns of awkward names."""

    def make(rows, extra=True):
        full = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "mark", "a", "b", "node", "gram", "pos", "keep", "root"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def odd(prose):
    """Null id, null and empty text, a repeated row, a long text, ties."""
    long = prose(99, 4_000)
    return [(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(2, 80)), (3, None), (4, ""), (5, " \n\t "), (6, long), (None, None), (7, "!!! ??? ..."), (8, prose(8, 5))]
