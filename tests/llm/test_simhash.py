from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from curatrix.llm import simhash

from .conftest import documents


def _near(seed: int, n: int, families: int) -> list[str]:
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(80)] for _ in range(families)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
        out.append(" ".join(w))
    return out


def _distances(texts):
    fps, _ = simhash.fingerprints(pa.array([t.lower() for t in texts]))
    return np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)


@pytest.mark.parametrize("cell_rows", [1 << 20, 40])
def test_pairs_match_brute_force(spark, cell_rows):
    texts = _near(1, 250, 12)
    fps, _ = simhash.fingerprints(pa.array(texts))
    uniq = np.unique(fps, axis=0)
    d = np.bitwise_count(uniq[:, None] ^ uniq[None]).sum(2)
    want = {(i, j, int(d[i, j])) for i in range(len(uniq)) for j in range(i + 1, len(uniq)) if d[i, j] <= simhash.RADIUS}
    prints = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(uniq)], "fid long, fp binary")
    got = {(r["a"], r["b"], r["distance"]) for r in simhash.pairs(prints, len(uniq), cell_rows).collect()}
    assert got == want and len(want) > 200


def test_vantage_point_tree_finds_all_values():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint16))
    queries = rng.integers(0, 1 << 16, 400).astype(np.uint16)
    got = {(int(i), int(j)) for p, q in simhash.near_values(points, queries) for i, j in zip(p, q)}
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ queries[None]) <= simhash.NEAR)
    assert got == set(zip(i.tolist(), j.tolist()))


def test_groups_match_brute_force(spark):
    texts = _near(2, 160, 9) + ["Same Text here"] * 4
    near = _distances(texts) <= simhash.RADIUS
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(texts))]
    docs = documents(spark, texts)
    for cell_rows in (simhash.CELL_ROWS, 30):
        got = {r["doc_id"]: (r["class_id"], r["links"]) for r in simhash.near_copies(docs, cell_rows).collect()}
        assert got == {i: (root[i], int(near[i].sum()) - 1) for i in range(len(texts))}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if root[i] == i}


def test_a_hot_cell_is_cut_and_loses_nothing(spark):
    # One word in front of 120 others: two thirds of the fingerprints lie close together in every segment.
    texts = _near(3, 240, 1) + _near(4, 120, 40)
    fps, _ = simhash.fingerprints(pa.array(texts))
    uniq = np.unique(fps, axis=0)
    d = np.bitwise_count(uniq[:, None] ^ uniq[None]).sum(2)
    prints = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(uniq)], "fid long, fp binary")
    got = simhash.pairs(prints, len(uniq), 20).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == int((np.triu(d <= simhash.RADIUS, 1)).sum())


def _noisy(rng, n: int, flip: float, centre: np.ndarray) -> np.ndarray:
    bits = np.tile(centre, (n, 1)) ^ (rng.random((n, simhash.BITS)) < flip).astype(np.uint8)
    return np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)


def test_a_hot_value_is_never_held_in_all_its_pairs():
    import tracemalloc

    rng = np.random.default_rng(11)
    fps = _noisy(rng, 2500, 0.03, rng.integers(0, 2, simhash.BITS).astype(np.uint8))
    seg = simhash.segments(fps)
    seg[:, :2] = 7, 9
    tracemalloc.start()
    sizes = [len(i) for i, _ in simhash._shard_pairs(seg, seg, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(fps) ** 2 and max(sizes) <= 1 << 18 and peak < 32 << 20


def test_classes_without_counts_match_brute_force(monkeypatch):
    for name, value in (("_AT_ONCE", 64), ("_TILE", 8), ("_RENEW", 256)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(12)
    centres = rng.integers(0, 2, (6, simhash.BITS)).astype(np.uint8)
    fps = np.concatenate([_noisy(rng, n, flip, c) for c, n, flip in zip(centres, (90, 60, 60, 40, 40, 80), (0.02, 0.05, 0.1, 0.12, 0.15, 0.5))])
    simhash.segments(fps)[:, 3] = 7  # one value that all have
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= simhash.RADIUS
    want = simhash._join(np.arange(len(fps)), *np.nonzero(near))
    fids = rng.permutation(len(fps))
    tables = [pa.table({"fid": fids[k], "fp": pa.array([f.tobytes() for f in fps[k]], pa.binary()), "docs": np.ones(len(k), np.int64)}) for k in np.array_split(rng.permutation(len(fps)), 3)]
    got = np.arange(len(fps))
    for segment in range(simhash.SEGMENTS):
        for home in tables:  # each query is at home in one shard only
            shard = simhash._Shard(home, segment, True, False)
            batches = [b for asks in tables for b in shard.ask(asks)] + list(shard.close())
            found = pa.Table.from_batches(batches)
            assert found["b"].null_count == 0
            got = simhash._join(got, found["a"].to_numpy(), found["b"].to_numpy())
    assert len(set(want)) > 40 and len({(w, g) for w, g in zip(want, got[fids])}) == len(set(want)) == len(set(got))


def test_copies_by_the_texts_as_they_came(spark):
    words = [f"w{i}" for i in range(90)]
    a, b = " ".join(words), " ".join([*words[:88], "x", "y"])
    now = documents(spark, [a, "x y", "other words of one kind", "w0 w1 cut", "x y"], [1, 2, 3, 4, None])
    came = spark.createDataFrame([(1, a), (2, b), (3, "other words of one kind"), (4, a), (4, "something else"), (None, a)], "doc_id long, text string")
    # Id 4 came with two texts and the null id is nobody's: both count as they are now.
    assert {r["doc_id"] for r in simhash.keep_first(now, came).collect()} == {None, 3, 4}
    assert {r["doc_id"] for r in simhash.keep_first(now).collect()} == {None, 1, 3, 4}


def test_odd_rows(odd, none):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    line = "one two three four five six"
    # The null id comes first among equal texts; null and blank texts always stay.
    assert (None, line) in rows and (4, line) not in rows
    assert rows.count((None, None)) == 1 and (1, None) in rows and (2, "") in rows and (3, "  \n\t") in rows
    assert simhash.near_copies(none).count() == 0 and simhash.keep_first(none).count() == 0
    got = {(r["doc_id"], r["class_id"], r["links"]) for r in simhash.near_copies(odd).collect()}
    # The line, its copy, which is listed twice but one document, and the line behind others (8) are near copies.
    assert {(None, 4, 2), (4, 4, 2), (8, 4, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0), (7, 7, 0)} <= got
    assert simhash.near_copies(odd).count() == odd.count()


def test_a_repeated_row_stays_once(spark):
    rows = [(1, "alpha beta gamma delta", 3), (1, "alpha beta gamma delta", 2), (2, "other words entirely here now", 1), (1, "alpha beta gamma delta", None), (5, None, 1), (5, None, 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n_chars long").repartition(3)
        # The first by the other columns stays; null text is no copy of anything.
        assert sorted(map(repr, map(tuple, simhash.keep_first(docs).collect()))) == sorted(map(repr, [(1, "alpha beta gamma delta", None), (2, "other words entirely here now", 1), (5, None, 1), (5, None, 1)]))
        assert {(r["doc_id"], r["class_id"], r["links"]) for r in simhash.near_copies(docs).collect()} == {(1, 1, 0), (2, 2, 0), (5, 5, 0)}
