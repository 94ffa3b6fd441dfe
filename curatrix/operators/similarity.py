"""Set-similarity over word n-grams: near-duplicate rows and contamination.

An exact inverted-index join. Words are cut in the JVM; their hashes become
n-gram hashes in one vectorised pass. Rows with equal n-gram sets are one
class, and only classes are joined, so a group of copies costs one set however
many rows it has. N-grams are ordered by rarity (counted over all classes in
2**20 buckets), then hash: two sets of Jaccard similarity >= t share one of
their first |A| - ceil(t |A|) + 1 (prefix filter), so only those are exploded
and joined. Sizes that cannot reach t are left out in the join, and surviving
pairs are compared on their whole sets. Thresholds are exact fractions, so
nothing depends on rounding. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bounded, materialise, trim

N, THRESHOLD = 13, "0.8"
#: Similar pairs that the driver takes in order itself, at most; more are settled in distributed rounds.
DRIVER_PAIRS = 1 << 18
_BITS, _BLOCK = 20, 1 << 16
#: N-grams or words of the rows that a worker works on at once.
_AT_ONCE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, size of each list) of an Arrow list column without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _sliced(run):
    """``run``, a function of an Arrow list column, over slices of about ``_AT_ONCE`` values: what it needs does not grow with the batch."""

    def whole(lists: pa.Array) -> pa.Array:
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // _AT_ONCE
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(size)] if len(size) else np.array([0, 0])
        out = pa.concat_arrays([run(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])
        trim()
        return out

    return whole


def _grams(n: int):
    """Column function: the distinct hashes of the n-word runs of an array of word hashes, sorted; a shorter text is one run."""

    def run(words: pa.Array) -> pa.Array:
        h, size = _flat(words)
        h, first = h.view(np.uint64), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        runs = np.where(size > 0, np.maximum(size - n, 0) + 1, 0)
        row = np.repeat(np.arange(len(size)), runs)
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        least = min(n, int(size[size > 0].min(initial=n)))
        acc = np.zeros(len(row), np.uint64)
        for k in range(n):
            some = slice(None) if k < least else np.flatnonzero(k < size[row])
            acc[some] = _mixed(acc[some] * _P + h[at[some] + k])
        o = np.lexsort((acc, row))
        row, acc = row[o], acc[o]
        new = np.r_[True, (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])] if len(row) else np.zeros(0, bool)
        return _lists(acc[new].view(np.int64), np.bincount(row[new], minlength=len(size)))

    return _once(run)


def _once(run):
    """A column function that filters on its result are not pushed through: they would run it again, and before the rows are spread."""
    return F.arrow_udf(_sliced(run), "array<bigint>").asNondeterministic()


def gram_sets(rows: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """(id, grams, size) of the rows that have words, written."""
    spark = bounded(rows.sparkSession)
    spread = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    hashed = F.transform(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    return materialise(spread.select("id", _grams(n)(hashed).alias("grams")).withColumn("size", F.size("grams")).filter("size > 0"))


def classes(sets: DataFrame) -> DataFrame:
    """(id, class): the rows with the first id of those with the same n-grams, written."""
    named = sets.select("id", F.xxhash64("grams").alias("s"))
    first = named.groupBy("s").agg(F.min("id").alias("class"), F.count("*").alias("rows"))
    # The classes of single rows need no join: most rows have one.
    many = first.filter("rows > 1").select("s", "class")
    return materialise(named.join(many, "s", "left").select("id", F.coalesce("class", "id").alias("class")))


def representatives(sets: DataFrame, classed: DataFrame) -> DataFrame:
    """The sets of the first row of each class."""
    return sets.join(classed.filter("id <> class").select("id"), "id", "left_anti")


def _levels(sets: DataFrame) -> np.ndarray:
    """log2 of the number of sets with n-grams of each bucket, in quarter steps."""

    def count(it):
        total = np.zeros(1 << _BITS, np.int64)
        for batch in it:
            values, _ = _flat(batch.column(0))
            for k in range(0, len(values), _AT_ONCE):
                np.add.at(total, values[k : k + _AT_ONCE].view(np.uint64) >> np.uint64(64 - _BITS), 1)
        trim()
        n = (1 << _BITS) // _BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([total[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(n)], pa.binary())], ["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in t["counts"])
        return pa.table({"block": t["block"][:1], "level": pa.array([(4 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(1 << _BITS, np.uint8)
    for r in sets.select("grams").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, level binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


def _prefix(sets: DataFrame, t: Fraction, level) -> DataFrame:
    """(id, size, gram): the n-grams of which two similar sets share one; ``level`` is the broadcast rarity."""
    num, den = t.numerator, t.denominator

    def front(grams: pa.Array) -> pa.Array:
        g, size = _flat(grams)
        row = np.repeat(np.arange(len(size)), size)
        o = np.lexsort((g, level.value[(g.view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)], row))
        keep = size - -(-size * num // den) + 1
        place = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        return _lists(g[o][place < keep[row]], keep)

    return sets.select("id", "size", F.explode(_once(front)(F.col("grams"))).alias("gram"))


def _reaches(t: Fraction, a: str, b: str):
    """Sizes that allow similarity t."""
    return (F.col(a) * t.denominator >= F.col(b) * t.numerator) & (F.col(b) * t.denominator >= F.col(a) * t.numerator)


def _similar(pairs: DataFrame, left: DataFrame, right: DataFrame, t: Fraction) -> DataFrame:
    a = left.select(F.col("id").alias("a_id"), F.col("grams").alias("a_grams"), F.col("size").alias("a_size"))
    b = right.select(F.col("id").alias("b_id"), F.col("grams").alias("b_grams"), F.col("size").alias("b_size"))
    both = pairs.join(a, "a_id").join(b, "b_id").withColumn("shared", F.size(F.array_intersect("a_grams", "b_grams")))
    union = F.col("a_size") + F.col("b_size") - F.col("shared")
    return both.filter(F.col("shared") * t.denominator >= union * t.numerator).select("a_id", "b_id", "shared", union.alias("union"))


def _rarity(sets: DataFrame):
    return sets.sparkSession.sparkContext.broadcast(_levels(sets))


def similar_pairs(sets: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """(a_id, b_id, shared, union), a_id < b_id, of all pairs with Jaccard >= threshold: of classes, where copies are not to be paired."""
    t = Fraction(threshold)
    front = materialise(_prefix(sets, t, _rarity(sets)))
    left, right = front.toDF("a_id", "a_n", "gram"), front.toDF("b_id", "b_n", "gram")
    pairs = left.join(right, "gram").filter((F.col("a_id") < F.col("b_id")) & _reaches(t, "a_n", "b_n")).select("a_id", "b_id").distinct()
    return _similar(pairs, sets, sets, t)


def contaminated(sets: DataFrame, reference: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """(id): rows that reach the threshold with any reference text."""
    t, level = Fraction(threshold), _rarity(reference)
    left = _prefix(sets, t, level).toDF("a_id", "a_n", "gram")
    right = _prefix(reference, t, level).toDF("b_id", "b_n", "gram")
    pairs = left.join(right, "gram").filter(_reaches(t, "a_n", "b_n")).select("a_id", "b_id").distinct()
    return _similar(pairs, sets, reference, t).select(F.col("a_id").alias("id")).distinct()


def greedy_removed(edges: DataFrame) -> DataFrame:
    """(id): rows that a pass in order removes, given the similar pairs (earlier, later) as (a_id, b_id).

    A row goes when an earlier *kept* row is similar. Each round settles every
    row whose earlier neighbours are settled or one of them is kept; the number
    of rounds is the longest chain of settled rows, not the number of rows.
    """
    edges = materialise(edges.select("a_id", "b_id"))
    if edges.count() <= DRIVER_PAIRS:
        gone: set = set()
        for r in edges.orderBy("b_id", "a_id").collect():
            if r["a_id"] not in gone:
                gone.add(r["b_id"])
        return edges.sparkSession.createDataFrame([(i,) for i in sorted(gone)], f"id {edges.schema['b_id'].dataType.simpleString()}")
    removed = edges.select(F.col("b_id").alias("id")).limit(0)
    undecided = materialise(edges.select(F.col("b_id").alias("id")).distinct())
    while True:
        # An earlier row that is neither removed nor undecided is kept.
        state = edges.join(undecided.select(F.col("id").alias("b_id")), "b_id").join(undecided.select(F.col("id").alias("a_id"), F.lit(True).alias("open")), "a_id", "left")
        state = state.join(removed.select(F.col("id").alias("a_id"), F.lit(True).alias("gone")), "a_id", "left")
        seen = materialise(state.groupBy("b_id").agg(F.max(F.col("open").isNull() & F.col("gone").isNull()).alias("hit"), F.max(F.col("open").isNotNull()).alias("waits")))
        removed = materialise(removed.union(seen.filter("hit").select("b_id")))
        left = materialise(undecided.join(seen.filter("hit or not waits").select(F.col("b_id").alias("id")), "id", "left_anti"))
        if left.isEmpty():
            return removed
        undecided = left


def removed_rows(sets: DataFrame, threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed ids, similar pairs of classes, classes): all rows of a class but its first go, and the first where the pass removes it.

    The rows of a class have the same similar rows, and what removes the first
    of them removes the others, too.
    """
    classed = classes(sets)
    pairs = materialise(similar_pairs(materialise(representatives(sets, classed)), threshold))
    gone = classed.filter("id <> class").select("id").union(greedy_removed(pairs))
    return gone, pairs, classed


def dedupe(rows: DataFrame, id_col: str, text_col: str, n: int = N, threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed ids). Rows are taken in order of their id; rows without words are never duplicates."""
    removed, _, _ = removed_rows(gram_sets(rows, id_col, text_col, n), threshold)
    return without(rows, removed, id_col), removed


def without(rows: DataFrame, removed: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` without those whose id is among the removed."""
    return rows.join(removed.select(F.col("id").alias(id_col)), id_col, "left_anti")


def decontaminate(rows: DataFrame, id_col: str, text_col: str, reference: DataFrame, ref_id: str, ref_text: str, n: int = N, threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed ids): rows that resemble no reference text. Without references nothing changes."""
    sets = gram_sets(rows, id_col, text_col, n)
    classed = classes(sets)
    gone = contaminated(representatives(sets, classed), gram_sets(reference, ref_id, ref_text, n), threshold)
    gone = materialise(classed.join(gone.select(F.col("id").alias("class")), "class", "left_semi").select("id"))
    return without(rows, gone, id_col), gone


def dedupe_decontaminate(rows: DataFrame, id_col: str, text_col: str, reference: DataFrame, ref_id: str, ref_text: str, n: int = N, threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows left, ids of duplicates, ids of the contaminated among the others): as one after the other, but n-grams are made once."""
    sets = gram_sets(rows, id_col, text_col, n)
    removed = materialise(removed_rows(sets, threshold)[0])
    # What is left has no two equal sets.
    gone = materialise(contaminated(without(sets, removed), gram_sets(reference, ref_id, ref_text, n), threshold))
    return without(rows, removed.union(gone), id_col), removed, gone
