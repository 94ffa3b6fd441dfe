from __future__ import annotations

import numpy as np
import pytest

from curatrix.llm import bitslice

KIND = "vec_id long, embedding array<float>, id int, v int, block int, shard int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], KIND)


def brute(rows, k):
    """(id, rank, neighbour, score) by comparing all rows."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    s = np.round(u @ u.T, 8) + 0.0
    out = []
    for a, i in enumerate(ids):
        best = sorted(((-s[a, b], j) for b, j in enumerate(ids) if j != i))[:k]
        out += [(i, r + 1, j, -m + 0.0) for r, (m, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard_rows,k", [(1 << 15, 10), (64, 3)])
def test_against_brute_force(spark, shard_rows, k):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(220), rng.normal(size=(220, 12)))]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, [0.0] * 12)]
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in bitslice.search(frame(spark, rows), k, shard_rows=shard_rows).collect()}
    want = brute(rows, k)
    assert len(got) == len(want)
    for i, r, j, s in want:
        assert abs(got[i, r][1] - s) < 2e-8
        if (i, r, j) != (i, r, got[i, r][0]):  # only where rounding may part a tie
            assert abs(dict((b, c) for a, _, b, c in want if a == i).get(got[i, r][0], s) - s) < 2e-8


def test_many_ties_go_to_the_lower_id(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)]
    got = bitslice.search(frame(spark, rows), 4, shard_rows=10).collect()
    assert {r["vec_id"]: None for r in got}.keys() == set(range(40))
    for r in got:
        others = [i for i in range(40) if i != r["vec_id"]]
        assert r["neighbor_id"] == others[r["rank"] - 1] and r["score"] == 1.0


def test_slices_add_up():
    rng = np.random.default_rng(4)
    x = bitslice.unit(rng.normal(size=(300, 9)))
    index = bitslice.Index(np.arange(300), x)
    slices, worth, bound = index.scores(x[0])
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:300].astype(np.int64) << b for b, s in enumerate(slices)), np.zeros(300, np.int64))
    exact = x @ x[0]
    # equal up to a constant and the bound, in units
    gap = total * worth - exact
    assert np.ptp(gap) <= 2 * bound * worth + 1e-9


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 6)]
    bad = [(None, [1.0, 1.0]), (10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [float("nan"), 1.0]), (15, [float("inf"), 0.0]), (5, [9.0, 9.0])]
    got = bitslice.search(frame(spark, good + bad), 10).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4, 5} and len(got) == 20
    assert bitslice.search(frame(spark, []), 3).count() == 0
    assert bitslice.search(frame(spark, [(1, [1.0, 2.0])]), 3).count() == 0


def test_against_sql(spark, tiny, oracle):
    from tests.compare import differences

    assert not differences(bitslice.query(spark, tiny), bitslice.ORACLE, oracle)


def test_huge_and_tiny_elements(spark):
    rows = [(1, [2e300, 1.0]), (2, [1.7e308, 1.7e308]), (3, [1e-300, 0.0]), (4, [0.0, 3.0]), (5, [-5e-324, 0.0])]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["neighbor_id"]): r["score"] for r in bitslice.search(wide, 10).collect()}
    half = round(2**-0.5, 8)
    assert len(got) == 20
    assert (got[1, 2], got[1, 3], got[1, 4], got[2, 4], got[3, 5]) == (half, 1.0, 0.0, half, -1.0)


def test_ids_of_any_type(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(60), rng.normal(size=(60, 6)))]
    name = lambda i: f"row {i:04d}"
    texts = spark.createDataFrame([(name(i), v) for i, v in rows] + [(None, rows[0][1])], "vec_id string, embedding array<float>")
    want = {(name(r["vec_id"]), r["rank"], name(r["neighbor_id"]), r["score"]) for r in bitslice.search(frame(spark, rows), 4).collect()}
    assert {tuple(r) for r in bitslice.search(texts, 4, shard_rows=20).collect()} == want


def test_some_rows_as_queries_and_every_row_searched(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(250, 5)))]
    every = {tuple(r) for r in bitslice.search(frame(spark, rows), 5).collect()}
    some = {tuple(r) for r in bitslice.search(frame(spark, rows), 5, queries=F.col("vec_id") % 100 == 0, shard_rows=40).collect()}
    assert some == {r for r in every if r[0] % 100 == 0} and len(some) == 15
