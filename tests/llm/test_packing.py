from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import packing
from tests.compare import differences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_bounds_are_optimal(histogram, buckets):
    histogram.sort()
    lengths, counts = np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram])

    def cost(tops):
        return sum(c * (min(t for t in tops if t >= x) - x) for x, c in histogram)

    best = min(cost([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], k))
    got = packing.bounds(lengths, counts, buckets)
    assert got == sorted(set(got)) and len(got) <= buckets and got[-1] == lengths[-1]
    assert cost(got) == best


def test_against_sql(spark, tiny, oracle):
    assert not differences(packing.query(spark, tiny), packing.ORACLE, oracle)


def test_batches_hold_the_budget(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = packing.pack(docs, budget=2000, buckets=5).toPandas()
    assert len(got) == docs.count() and got["bucket"].nunique() <= 5
    for (_, length), b in got.groupby(["bucket", "bucket_length"]):
        rows = max(1, 2000 // max(length, 1))
        assert (b["n_tokens"] <= length).all() and b.groupby("batch").size().max() <= rows
        assert sorted(b["batch"] * rows + b["place"]) == list(range(len(b)))
        o = b.sort_values(["batch", "place"])
        assert o["n_tokens"].is_monotonic_increasing


def test_odd_rows(spark, odd, none):
    got = packing.pack(odd, budget=12, buckets=3).collect()
    assert len(got) == odd.count()
    o = sorted(got, key=lambda r: (r["bucket"], r["batch"], r["place"]))
    # Null ids come first in their length; (4, line) is there twice, in places that follow one another.
    assert [(r["n_tokens"], r["doc_id"]) for r in o] == [(0, None), (0, 1), (0, 2), (0, 3), (1, 6), (1, 7), (1, 9), (6, None), (6, 4), (6, 4), (8, 8), (60_000, 5)]
    for (_, length), b in groupby(o, key=lambda r: (r["bucket"], r["bucket_length"])):
        rows = max(1, 12 // max(length, 1))
        at = [r["batch"] * rows + r["place"] for r in b]
        assert at == list(range(len(at)))
    assert packing.pack(none).count() == 0


def test_ids_of_any_type(spark):
    texts = [(f"id {i:03d}", "w " * (i % 3)) for i in range(90)] + [(None, "w")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id string, text string"), budget=8, buckets=2).collect()
    o = [(r["n_tokens"], r["doc_id"]) for r in sorted(got, key=lambda r: (r["bucket"], r["batch"], r["place"]))]
    assert o == sorted(o, key=lambda r: (r[0], r[1] is not None, r[1])) and len(o) == 91
