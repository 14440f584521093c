import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("na", "lor", "mit", "den", "sir")]
    return " ".join(rng.choice([*words, "the", "of", "and", "is"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with ids from 0, or from (id, text) pairs."""

    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with names the operators use."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [
        (1, "The cat and the dog sat on the mat of the house.", "en", "a", 48),
        (1, "The cat and the dog sat on the mat of the house.", "en", "a", 48),
        (2, None, "en", "a", 3),
        (None, "a text without an id", None, None, None),
        (None, "a text without an id", None, None, None),
        (3, "", "en", "b", 0),
        (4, " \n\t ", None, "b", -5),
        (5, long, "en", "b", len(long)),
        (6, long[:-30] + "another end of this text", "en", None, len(long)),
        (7, "12345 !!! ???", "de", "c", 13),
        (8, "𝔘𝔫𝔦 ünï İ \U0001f600 é", "de", "c", 12),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("row", "fp", "key", "block", "slot", "score", "component", "doc", "found", "seed", "bucket", "hash", "Source2"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
