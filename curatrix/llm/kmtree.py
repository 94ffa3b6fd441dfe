"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

**Tree.** Unit vectors are split by k-means, level by level, ``BRANCH`` ways,
down to leaves of ``LEAF_ROWS`` rows. The tree is fitted on a sample of at most
about ``SAMPLE_ROWS`` rows and ``SAMPLE_VALUES`` vector elements (rows of least
hash); every row is then indexed: it goes to the leaf of the nearest centroid
at each level. Leaves that are neighbours in the tree share a shard; a leaf
with more rows than a shard holds is split over several by hash.

**Search** is best bin first: one priority queue over all levels holds the
branches not taken, nearest centroid first, and leaves are visited in that
order. A query is sent once to each shard that has leaves it visits, with
their numbers; a shard's task lays out its leaves once and streams the queries
past them. The shards' best rows are merged.

**Calibration.** The number of leaf visits is not set but found: for a sample
of queries the true neighbours are computed by brute force over all rows, and
visits are widened leaf by leaf until the sample's recall, less two standard
errors, reaches ``target``. Visiting all leaves is exact.

Defined results: as in the exact search (``bitslice``): unusable rows are left
out, of rows with one id that of the least vector counts, a row is not its own
neighbour, scores are cosines rounded to 8 decimals and ties go to the lower
id; ids may be of any type that can be ordered. With fewer than k others, all
that were visited are returned. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bitslice import asking, matrix, renamed, unit, vectors
from .textarrays import mix64

K = 10
LEAF_ROWS = 64
BRANCH = 16
TARGET = 0.96
#: What the tree is fitted on, at most (about).
SAMPLE_ROWS, SAMPLE_VALUES = 1 << 16, 1 << 22
#: Queries whose true neighbours calibrate the search.
CALIBRATION = 256
#: Rows of a shard, at most; and so few that smaller shards would not be worth a task.
SHARD_ROWS, LEAST_ROWS = 1 << 15, 1 << 10


class Tree:
    """Nodes with their children's centroids; a child is a node (>= 0) or a leaf (~number)."""

    def __init__(self, dims: int):
        self.dims, self.centroids, self.norms, self.kids, self.leaves = dims, [], [], [], 0

    def add(self) -> int:
        self.centroids.append(np.zeros((0, self.dims)))
        self.norms.append(np.zeros(0))
        self.kids.append([])
        return len(self.kids) - 1

    def set(self, node: int, centroids: np.ndarray, kids: list[int]) -> None:
        self.centroids[node], self.norms[node], self.kids[node] = centroids, (centroids * centroids).sum(1), kids

    def leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def best_bins(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        queue, n = [(0.0, 0, 0 if self.kids else ~0)], 1
        while queue:
            node = heapq.heappop(queue)[2]
            while node >= 0:
                far = self.norms[node] - 2 * (self.centroids[node] @ q)
                at = int(far.argmin())
                for k, kid in enumerate(self.kids[node]):
                    if k != at:
                        heapq.heappush(queue, (far[k], n, kid))
                        n += 1
                node = self.kids[node][at]
            yield ~node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by nearest centroid at each level."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))] if self.kids else []
        while stack:
            node, at = stack.pop()
            own = (self.norms[node] - 2 * (x[at] @ self.centroids[node].T)).argmin(1)
            for k, kid in enumerate(self.kids[node]):
                some = at[own == k]
                if kid < 0:
                    out[some] = ~kid
                elif len(some):
                    stack.append((kid, some))
        return out


def _lloyd(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k-means from rows spread evenly over the input: no random choice."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(np.int64))].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def grow(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree of the unit vectors ``x``, leaves numbered depth first: neighbours in number are near in space."""
    tree = Tree(x.shape[1])

    def split(at: np.ndarray, node: int):
        c = _lloyd(x[at], min(BRANCH, -(-len(at) // leaf_rows) + 1))
        own = ((c * c).sum(1) - 2 * (x[at] @ c.T)).argmin(1)
        used = [k for k in range(len(c)) if (own == k).any()]
        kids = []
        for k in used:
            some = at[own == k]
            if len(some) <= leaf_rows or len(used) == 1:
                kids.append(tree.leaf())
            else:
                kids.append(tree.add())
                split(some, kids[-1])
        tree.set(node, c[used], kids)

    if len(x):
        split(np.arange(len(x)), tree.add())
    return tree


def fit(good: DataFrame, n: int, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, sample_values: int = SAMPLE_VALUES) -> Tree:
    """A tree grown from about min(sample_rows, sample_values / dimensions) rows (id, v), those of least hash."""
    dims = len(good.select("v").first()["v"])
    share = min(1.0, min(sample_rows, sample_values // dims) / n)
    chosen = good.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    x = unit(matrix(chosen.orderBy("id").select("v").toArrow()["v"]))
    return grow(x if len(x) else np.zeros((1, dims)), leaf_rows)


def _truth(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[int]]:
    """Leaves of the true neighbours of the sampled queries, by brute force over all rows (leaf, id, v)."""

    def run(it):
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in it:
            own, leaf, sims = batch.column("id").to_numpy(), batch.column("leaf").to_numpy(), np.round(x @ unit(matrix(batch.column("v"))).T, 8)
            for i in range(len(ids)):
                keep = own != ids[i]
                f, s, b = (np.r_[old, new[keep]] for old, new in zip(best[i], (own, sims[i], leaf)))
                o = np.lexsort((f, -s))[:k]
                best[i] = f[o], s[o], b[o]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(b[0]) for b in best])), *(pa.array(np.concatenate([b[c] for b in best])) for c in range(3))], ["q", "id", "score", "leaf"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    out: dict[int, list[int]] = {int(i): [] for i in ids}
    for r in rows.mapInArrow(run, "q long, id long, score double, leaf long").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect():
        out[r["q"]].append(r["leaf"])
    return out


def calibrate(rows: DataFrame, tree: Tree, k: int, target: float, sample: int = CALIBRATION) -> tuple[int, float]:
    """(visits, recall): the fewest leaf visits whose recall on sampled queries reaches ``target`` by two standard errors.

    A true neighbour is found once its leaf is visited, so widening the visits
    leaf by leaf only needs each neighbour's leaf and the order of the leaves.
    """
    chosen = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).collect()
    ids, x = np.array([r["id"] for r in chosen]), unit(np.array([r["v"] for r in chosen]))
    truth = _truth(rows, ids, x, k)
    found = np.zeros((len(ids), tree.leaves + 1))
    for i, qid in enumerate(ids):
        open_ = truth[int(qid)]
        if not open_:
            continue
        missing, of = set(open_), len(open_)
        for n, leaf in enumerate(tree.best_bins(x[i]), 1):
            if leaf in missing:
                missing.discard(leaf)
                found[i, n] = open_.count(leaf) / of
            if not missing:
                break
    some = np.array([bool(truth[int(i)]) for i in ids])
    if not some.any():
        return tree.leaves, 1.0
    recall = np.cumsum(found[some], axis=1)
    sure = recall.mean(0) - 2 * recall.std(0) / np.sqrt(some.sum())
    enough = np.flatnonzero(sure >= target)
    # Visiting all leaves is exact.
    visits = max(1, int(enough[0])) if len(enough) else tree.leaves
    return visits, float(recall.mean(0)[visits])


def _scan(ids: np.ndarray, x: np.ndarray, start: np.ndarray, leaves: dict[int, int], qids: np.ndarray, q: np.ndarray, wanted: list[np.ndarray], k: int):
    """(query, id, score) of at least the k best rows of each query in the leaves it wants; leaf number n has rows start[n] to start[n + 1]."""
    asked = np.repeat(np.arange(len(qids)), [len(w) for w in wanted])
    leaf = np.array([leaves.get(b, -1) for w in wanted for b in w.tolist()], np.int64)
    asked, leaf = asked[leaf >= 0], leaf[leaf >= 0]
    o = np.argsort(leaf, kind="stable")
    asked, leaf = asked[o], leaf[o]
    least = np.full(len(qids), -np.inf)
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def settle():
        nonlocal held, size
        a, f, s = (np.concatenate(c) for c in zip(*held))
        o = np.lexsort((f, -s, a))
        a, f, s = a[o], f[o], s[o]
        first = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1]
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        least[a[place == k - 1]] = s[place == k - 1]
        keep = place < k
        held, size = [(a[keep], f[keep], s[keep])], int(keep.sum())

    for n, at in zip(*_runs(leaf)):
        own, lo, hi = asked[at], start[n], start[n + 1]
        s = np.round(q[own] @ x[lo:hi].T, 8) + 0.0
        i, j = np.nonzero((s >= least[own][:, None]) & (qids[own][:, None] != ids[None, lo:hi]))
        if len(i):
            held.append((own[i], ids[lo + j], s[i, j]))
            size += len(i)
            if size > 1 << 19:
                settle()
    if held:
        settle()
        yield from held


def _runs(x: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Values of a sorted array and where each stands."""
    cut = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else np.zeros(1, np.int64)
    return x[cut[:-1]], [slice(a, b) for a, b in zip(cut, cut[1:])]


def shard_leaves(counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard, number of shards) of each leaf, and how many shards there are; a leaf too large for a shard is split over several."""
    room = max(1, -(-int(counts.sum()) // shards))
    first, many, at, free = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
    for leaf, n in enumerate(counts.tolist()):
        if n > room:
            many[leaf] = -(-n // room)
            first[leaf], at, free = at + 1, at + int(many[leaf]), 0
        else:
            if at < 0 or n > free:
                at, free = at + 1, room
            first[leaf] = at
            free -= n
    return first, many, at + 1


def search(rows: DataFrame, k: int = K, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None, leaf_rows: int = LEAF_ROWS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): about ``target`` or more of the k nearest other rows, of all rows, of every row for which ``queries`` holds (default: of every row)."""
    spark = common.tune(rows.sparkSession)
    good, names = vectors(rows, id_col, vec_col)
    n = good.count()
    empty = spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, score double")
    if not n:
        return renamed(empty, names)
    tree = fit(good, n, leaf_rows, sample_rows)
    share = spark.sparkContext.broadcast(tree)

    def place(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(share.value.assign(unit(matrix(batch.column("v"))))), batch.column("id"), batch.column("v")], ["leaf", "id", "v"])

    indexed = common.written(good.mapInArrow(common.lean(place), "leaf long, id long, v array<double>"))
    counts = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    visits, _ = calibrate(indexed, tree, k, target)
    first, many, shards = shard_leaves(counts, max(1, -(-n // shard_rows), min(common.parts(spark), -(-n // LEAST_ROWS))))
    plan = spark.sparkContext.broadcast((first, many))

    def home(it):
        for batch in it:
            leaf, ids = batch.column("leaf").to_numpy(), batch.column("id").to_numpy()
            first_, many_ = plan.value
            shard = first_[leaf] + (mix64(ids.astype(np.uint64)) % many_[leaf].astype(np.uint64)).astype(np.int64)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(m, bool)), batch.column("leaf"), batch.column("id"), batch.column("v"), pa.nulls(m, pa.list_(pa.int32()))], _MEET)

    def ask(it):
        for batch in it:
            first_, many_ = plan.value
            row, shard, leaves = [], [], []
            for r, q in enumerate(unit(matrix(batch.column("v")))):
                bins = np.fromiter(islice(share.value.best_bins(q), visits), np.int64)
                spread = np.repeat(bins, many_[bins])
                of = first_[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(many_[bins]) - many_[bins], many_[bins])
                o = np.argsort(of, kind="stable")
                for s, at in zip(*_runs(of[o])):
                    row.append(r)
                    shard.append(s)
                    leaves.append(spread[o][at])
            take = pa.array(row, pa.int64())
            m = len(row)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.ones(m, bool)), pa.nulls(m, pa.int64()), batch.column("id").take(take), batch.column("v").take(take), pa.array(leaves, pa.list_(pa.int32()))], _MEET)

    def meet(it):
        for _, home_, asks_ in common.met(it):
            if home_ is not None:
                leaf, ids = home_["leaf"].to_numpy(), home_["id"].to_numpy()
                o = np.lexsort((ids, leaf))
                numbers, at = _runs(leaf[o])
                ids, x, start = ids[o], unit(matrix(home_["v"]))[o], np.r_[[s.start for s in at], len(o)]
                leaves = {int(b): i for i, b in enumerate(numbers)}
                continue
            qids, wanted = asks_.column("id").to_numpy(), asks_.column("leaves")
            for a, f, s in _scan(ids, x, start, leaves, qids, unit(matrix(asks_.column("v"))), [np.asarray(w.values) for w in wanted], k):
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(f), pa.array(s)], ["vec_id", "neighbor_id", "score"])

    ddl = "shard int, asks boolean, leaf long, id long, v array<double>, leaves array<int>"
    asks = asking(rows, good, names, queries, id_col).repartition(common.parts(spark), "id").mapInArrow(common.lean(ask), ddl)
    both = indexed.mapInArrow(common.lean(home), ddl).union(asks)
    each = common.placed(both, "shard", shards, F.col("asks")).mapInArrow(common.lean(meet), "vec_id long, neighbor_id long, score double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    return renamed(each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score"), names)


_MEET = ["shard", "asks", "leaf", "id", "v", "leaves"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 100, among all rows."""
    return search(common.table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)
