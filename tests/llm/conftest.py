from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators' own columns have or could have.
CLASHES = ["key", "__key", "other_key", "gone", "left", "language", "copy", "s", "fp", "start", "n_tokens"]


def documents(spark, texts, ids=None, langs=None):
    """A documents table with extra, clashing columns."""
    from pyspark.sql import functions as F

    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, g, "src", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, clashing columns."""
    long_ = " ".join(f"w{i}" for i in range(60_000))
    line = "one two three four five six"
    texts = [None, "", "  \n\t", line, line, line, None, long_, "é", "...", "a\n\nb\n" + line, "x" * 5000]
    ids = [1, 2, 3, 4, 4, None, None, 5, 6, 7, 8, 9]
    return documents(spark, texts, ids, ["en", "en", None, "en", "en", "en", None, "en", "fr", "fr", "fr", "fr"])


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
