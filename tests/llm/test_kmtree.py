from __future__ import annotations

import numpy as np
import pytest

from curatrix.llm import kmtree
from curatrix.llm.bitslice import unit, vectors

from .test_bitslice import brute, frame


def _rows(n: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(i, [float(a) for a in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(n)]


def _recall(found, rows, k=10):
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    want: dict = {}
    for i, _, j, _ in brute(rows, k):
        if i in got:
            want.setdefault(i, set()).add(j)
    assert all(len(v) == k for v in got.values())
    return len(got), sum(len(got[i] & want[i]) for i in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("shard_rows,sample_rows", [(1 << 15, 1 << 16), (100, 400)])
def test_recall_of_every_row(spark, shard_rows, sample_rows):
    # 1,200 queries, of which 256 calibrate the search: the others are held out.
    rows = _rows(1200)
    n, recall = _recall(kmtree.search(frame(spark, rows), 10, leaf_rows=16, shard_rows=shard_rows, sample_rows=sample_rows), rows)
    assert n == 1200 and recall >= kmtree.TARGET


def test_fewer_than_half_of_the_leaves_are_visited(spark):
    good, _ = vectors(frame(spark, _rows(3000)))
    tree = kmtree.fit(good, 3000, 16)
    leaves = [(i, int(b)) for i, b in enumerate(tree.assign(unit(np.array([r["v"] for r in good.orderBy("id").collect()]))))]
    placed = good.join(spark.createDataFrame(leaves, "id long, leaf long"), "id").select("leaf", "id", "v")
    visits, recall = kmtree.calibrate(placed, tree, 10, kmtree.TARGET)
    assert recall >= kmtree.TARGET and visits < tree.leaves / 2


def test_a_hot_leaf_is_split_over_shards():
    first, many, shards = kmtree.shard_leaves(np.array([5, 1000, 5, 0, 90, 90]), 10)
    assert many.tolist() == [1, 9, 1, 1, 1, 1] and first.tolist() == [0, 1, 10, 10, 10, 11] and shards == 12


def test_scores_and_ranks(spark):
    rows = _rows(150, 2)
    for r in kmtree.search(frame(spark, rows), 5).collect():
        a, b = np.float64(np.float32(rows[r["vec_id"]][1])), np.float64(np.float32(rows[r["neighbor_id"]][1]))
        assert r["vec_id"] != r["neighbor_id"] and abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-7
        assert 1 <= r["rank"] <= 5


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(9).normal(size=(2000, 6))
    tree = kmtree.grow(x, 50)
    leaf = tree.assign(x)
    assert np.bincount(leaf, minlength=tree.leaves).max() <= 50
    order = list(tree.best_bins(x[3]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == leaf[3]


def test_odd_rows(spark):
    same = [(i, [1.0, 0.0]) for i in range(300)]
    got = kmtree.search(frame(spark, same), 3, shard_rows=50).collect()
    assert {r["vec_id"] for r in got} == set(range(300))
    assert all(r["score"] == 1.0 for r in got)
    bad = [(None, [1.0, 1.0]), (10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [float("nan"), 1.0])]
    assert {r["vec_id"] for r in kmtree.search(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0]), *bad]), 3).collect()} == {1, 2, 3}
    assert kmtree.search(frame(spark, []), 3).count() == 0
    assert kmtree.search(frame(spark, [(1, [1.0, 2.0])]), 3).count() == 0
