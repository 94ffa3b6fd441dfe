from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import suffix
from tests.compare import differences

from .conftest import documents

W = suffix.WINDOW


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=5))
def test_two_stage_sorting(blocks):
    t = np.array([v for b in blocks for v in [*b, 0]])
    got = suffix.sort_suffixes(t, 64)
    assert sorted(got.tolist()) == list(range(len(t)))

    def key(i):
        end = i + t[i:].tolist().index(0)
        return t[i:end].tolist()

    keys = [key(i) for i in got]
    assert keys == sorted(keys)
    lcp = suffix.common_prefixes(t, got, 64)
    for k in range(1, len(keys)):
        a, b = keys[k - 1], keys[k]
        n = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
        assert lcp[k] == n


def brute(texts: dict[int, str]) -> set[tuple[int, int]]:
    """(document, word) of all words that go."""
    first: dict[tuple, tuple[int, int]] = {}
    out = set()
    for d in sorted(texts):
        w = texts[d].split()
        for i in range(len(w) - W + 1):
            g = tuple(w[i : i + W])
            if g not in first:
                first[g] = (d, i)
            elif first[g][0] != d or i >= first[g][1] + W:
                out.update((d, j) for j in range(i, i + W))
    return out


def _texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(300)}" for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(8)]
    out = []
    for _ in range(60):
        w: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
            part = rng.choice(shared)
            a = rng.randrange(len(part) // 3 + 1)
            w += part[a:] if rng.random() < 0.7 else part
        out.append(" ".join(w))
    out += [" ".join(["again"] * 170), " ".join(["again"] * 60), " ".join("ab" * 3 if k % 2 else "c" for k in range(140))]
    return out


@pytest.mark.parametrize("seed,hot_words", [(1, suffix.HOT_WORDS), (2, suffix.HOT_WORDS), (2, 600), (1, 0)])
def test_against_brute_force(spark, seed, hot_words):
    texts = _texts(seed)
    want = brute(dict(enumerate(texts)))
    docs = documents(spark, texts)
    got = set()
    for r in suffix.passages(docs, hot_words).collect():
        span = {(r["doc_id"], j) for j in range(r["start_word"], r["end_word"])}
        assert not span & got and r["first_doc_ids"]
        got |= span
    assert got == want and len(want) > 1000
    left = {r["doc_id"]: r["text"].split() for r in suffix.remove_repeats(docs, hot_words).collect()}
    for d, t in enumerate(texts):
        assert left.get(d, []) == [w for j, w in enumerate(t.split()) if (d, j) not in want]


def test_against_sql(spark, tiny, oracle):
    assert not differences(suffix.query(spark, tiny), suffix.ORACLE, oracle)


def test_odd_rows(spark, odd, none):
    done = suffix.remove_repeats(odd)
    assert done.columns == odd.columns
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]))
    assert sorted(map(key, done.collect())) == sorted(map(key, odd.collect()))
    assert suffix.passages(odd).count() == 0
    assert suffix.passages(none).count() == 0 and suffix.remove_repeats(none).count() == 0


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [passage + " tail one", "lead " + passage, "lead " + passage, passage], [None, 5, 5, 9])
    got = sorted((repr(r["doc_id"]), r["text"]) for r in suffix.remove_repeats(docs).collect())
    assert got == [("5", "lead "), ("5", "lead "), ("None", passage + " tail one")]


def test_ids_of_any_type(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [("b", passage + " tail"), ("a", "lead " + passage), (None, "none " + passage), ("c", passage)]
    docs = spark.createDataFrame(rows[:2] + rows[3:], "doc_id string, text string")
    got = {(r["doc_id"], r["start_word"], r["end_word"], tuple(r["first_doc_ids"])) for r in suffix.passages(docs).collect()}
    assert got == {("b", 0, 60, ("a",)), ("c", 0, 60, ("a",))}
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for hot_words in (suffix.HOT_WORDS, 10):
        # The null id comes first.
        got = {(r["doc_id"], r["start_word"], r["end_word"], tuple(r["first_doc_ids"])) for r in suffix.passages(docs, hot_words).collect()}
        assert got == {("a", 1, 61, ()), ("b", 0, 60, ()), ("c", 0, 60, ())}


def test_many_copies_of_one_passage(spark):
    """50,000 documents of which each holds the passage: all but the first lose it, whether or not it is hot."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(f" {passage} y"), F.col("id").cast("string")).alias("text"))
    for hot_words in (suffix.HOT_WORDS, 1 << 16):
        got = suffix.passages(docs, hot_words).groupBy("start_word", "end_word", "first_doc_ids").count().collect()
        assert [tuple(r) for r in got] == [(1, 61, [0], 49_999)]
