"""Exact top-k search by cosine with a bit-sliced index.

Rows are cut into shards; a task builds the index of one shard, once, and
streams the queries past it. A shard's index keeps, for each attribute,
its quantised values as bit slices: slice b of attribute a is the bitmap of
rows whose value has bit b set. A query's weights are quantised too, and its
score is the sum of its attributes' slices, shifted by the set bits of the
weights (those of negative weights inverted), which carry-save adders add with
bitmap arithmetic: the result is the quantised score of all rows, as bit
slices. The top rows are found from the most significant slice downward.

Quantising moves a score by at most a bound that is computed for each query.
Rows below the k-th quantised score by more than twice the bound cannot be
among the top k; all others, the boundary rows, are scored exactly. Shards'
tops are merged by (score descending, id ascending).

Every row is searched, and each row is shuffled once; a query goes to every
shard, so the work is queries x rows.

Defined results: a row is not its own neighbour, nor is a row of the same id.
Scores are cosines rounded to 8 decimals; ties go to the lower id. The zero
vector has cosine 0 with all. Rows whose id, vector or any element is null,
NaN or infinite, or whose length isn't the most frequent one (of equally
frequent ones, the longest), are neither queries nor results; any finite
element is usable, however large or small. Rows with one id count once, with
the least vector; they are a query when any of them is. Ids may be of any
type that can be ordered. With fewer than k others, all are returned. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Rows of a shard, at most but for the hash's spread; and so few that smaller shards would not be worth a task.
SHARD_ROWS, LEAST_ROWS = 1 << 15, 1 << 10
X_BITS, Q_BITS = 6, 6


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame | None]:
    """The usable rows as (id, v), written: no nulls, finite, of the most frequent length; of rows with one id, that of the least vector.

    ``id`` is a number of the ids' order, and the second table, None for
    integer ids, has the ids (id, number).
    """
    names = common.id_numbers(rows, id_col)
    good = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null and id is not null and size(v) > 0")
    good = good.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if length:
        good = good.filter(F.size("v") == length[0]["n"])
    good = good.groupBy("id").agg(F.min("v").alias("v"))
    if names is not None:
        good = good.join(names, "id").select(F.col("number").alias("id"), "v")
    return common.written(good.select(F.col("id").cast("long"), "v")), names


def renamed(found: DataFrame, names: DataFrame | None) -> DataFrame:
    """``found`` (vec_id, rank, neighbor_id, score) with the ids that the numbers stand for."""
    if names is None:
        return found
    left, right = names.toDF("left_id", "vec_id"), names.toDF("right_id", "neighbor_id")
    return found.join(left, "vec_id").join(right, "neighbor_id").select(F.col("left_id").alias("vec_id"), "rank", F.col("right_id").alias("neighbor_id"), "score")


def asking(rows: DataFrame, good: DataFrame, names: DataFrame | None, queries: Column | None, id_col: str) -> DataFrame:
    """The rows of ``good`` that are queries: all, or those whose id is that of a row for which ``queries`` holds."""
    if queries is None:
        return good
    wanted = rows.filter(queries).select(F.col(id_col).alias("id")).distinct()
    wanted = wanted.select(F.col("id").cast("long")) if names is None else wanted.join(names, "id").select(F.col("number").alias("id"))
    return good.join(wanted, "id", "left_semi")


def matrix(col) -> np.ndarray:
    """(n, d) float64 of an Arrow list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by powers of two first, which is exact, keeps squares from overflowing or vanishing."""
    if x.size:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1)


class Index:
    """Bit slices of a shard's unit vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, d = x.shape
        self.words = -(-n // 64)
        self.low = x.min(0)
        self.step = np.maximum((x.max(0) - self.low) / ((1 << X_BITS) - 1), 1e-12)
        grid = np.rint((x - self.low) / self.step).astype(np.uint8)
        #: error of each attribute's value, at most
        self.error = np.abs(x - (self.low + grid * self.step)).max(0)
        padded = np.zeros((d, self.words * 64), np.uint8)
        padded[:, :n] = grid.T
        bits = np.stack([np.packbits((padded >> b) & 1, axis=1, bitorder="little") for b in range(X_BITS)], axis=1)
        self.slices = np.ascontiguousarray(bits).view(np.uint64).reshape(d, X_BITS, self.words)
        self.all = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], float, float]:
        """Bit slices of the quantised scores, the worth of one unit of them, and the bound of their error in units.

        score(x) = sum_a q_a low_a + sum_a (q_a step_a) grid_a, of which the first
        sum is the same for all rows and left out.
        """
        w = q * self.step
        top = np.abs(w).max()
        if top == 0:
            return [], 1.0, 0.0
        worth = top / ((1 << Q_BITS) - 1)
        m = np.rint(np.abs(w) / worth).astype(np.int64)
        error = float((np.abs(np.abs(w) - m * worth) * ((1 << X_BITS) - 1) / 2).sum()) + float((np.abs(q) * self.error).sum())
        heaps: list[list[np.ndarray]] = [[] for _ in range(Q_BITS + X_BITS + 16)]
        for s in range(Q_BITS):
            on = (m >> s) & 1 == 1
            for b in range(X_BITS):
                plus, minus = np.flatnonzero(on & (w > 0)), np.flatnonzero(on & (w < 0))
                if len(plus):
                    heaps[s + b].append(self.slices[plus, b])
                if len(minus):
                    # -m * g = m * (top - g) - m * top: inverted slices, and a constant
                    heaps[s + b].append(~self.slices[minus, b])
        out = []
        for level, heap in enumerate(heaps):
            if not heap:
                if any(heaps[level + 1 :]):
                    out.append(np.zeros(self.words, np.uint64))
                    continue
                break
            rest = np.concatenate(heap)
            while len(rest) > 1:
                if len(rest) == 2:
                    heaps[level + 1].append((rest[0] & rest[1])[None])
                    rest = (rest[0] ^ rest[1])[None]
                    break
                three = len(rest) // 3
                a, b, c = rest[:three], rest[three : 2 * three], rest[2 * three : 3 * three]
                x = a ^ b
                heaps[level + 1].append((a & b) | (c & x))
                rest = np.concatenate([x ^ c, rest[3 * three :]])
            out.append(rest[0])
        return out, worth, error / worth

    def top(self, q: np.ndarray, qid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the shard's top k for a query, itself left out."""
        mine = np.flatnonzero(self.ids == qid)
        open_ = self.all.copy()
        for r in mine:
            open_[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        have = int(np.bitwise_count(open_).sum())
        if not have:
            return self.ids[:0], np.zeros(0)
        slices, _, bound = self.scores(q)
        rows = open_
        if have > k and slices:
            # The k-th largest quantised score, from the most significant slice downward.
            sure, edge, kth = 0, open_, 0
            for level in range(len(slices) - 1, -1, -1):
                with_bit = edge & slices[level]
                n = int(np.bitwise_count(with_bit).sum())
                if sure + n >= k:
                    edge, kth = with_bit, kth | (1 << level)
                else:
                    sure, edge = sure + n, edge & ~slices[level]
            least = kth - int(np.floor(2 * bound)) - 1
            if least > 0:
                # Rows with a score >= least, again by slices.
                above, equal = np.zeros(self.words, np.uint64), open_
                for level in range(len(slices) - 1, -1, -1):
                    if least >> level & 1:
                        equal = equal & slices[level]
                    else:
                        above |= equal & slices[level]
                        equal = equal & ~slices[level]
                rows = above | equal
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        exact = np.round(np.einsum("ij,j->i", self.x[at], q), 8) + 0.0
        if len(at) > k:
            part = np.partition(exact, len(exact) - k)[len(exact) - k]
            keep = exact >= part
            at, exact = at[keep], exact[keep]
        o = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at[o]], exact[o]


def search(rows: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k nearest other rows, of all rows, of every row for which ``queries`` holds (default: of every row)."""
    spark = common.tune(rows.sparkSession)
    good, names = vectors(rows, id_col, vec_col)
    n = good.count()
    # As many shards as there are tasks at least, so that none waits for another.
    shards = max(1, -(-n // shard_rows), min(common.parts(spark), -(-n // LEAST_ROWS)))
    home = good.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asks = asking(rows, good, names, queries, id_col)
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")

    def meet(it):
        index = None
        for _, home_, asks_ in common.met(it):
            if home_ is not None:
                ids = home_["id"].to_numpy()
                o = np.argsort(ids, kind="stable")
                index = Index(ids[o], unit(matrix(home_["v"]))[o])
                continue
            qids = asks_.column("id").to_numpy()
            got = [index.top(q, qid, k) for qid, q in zip(qids, unit(matrix(asks_.column("v"))))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], ["vec_id", "neighbor_id", "score"])

    part = common.placed(home.union(asks), "shard", shards, F.col("asks")).mapInArrow(common.lean(meet), "vec_id long, neighbor_id long, score double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    return renamed(part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score"), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 100, among all rows."""
    return search(common.table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


ORACLE = f"""
with v as (select vec_id, cast(embedding as double[]) as v from embeddings),
u as (select vec_id, v, sqrt(list_inner_product(v, v)) as n from v),
s as (select a.vec_id, b.vec_id as neighbor_id, round(list_inner_product(a.v, b.v) / (a.n * b.n), 8) as score from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by vec_id order by score desc, neighbor_id) as rank from s)
select vec_id, cast(rank as integer) as rank, neighbor_id, score from r where rank <= {K}
"""
