"""Embedding diversity, sampling caps and the embedding cache."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(key, text): the distinct texts whose embedding is not cached."""
    keyed = texts.select(T.cache_key(F.lit(model), F.col(text_col)).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def capped(rows: DataFrame, id_col: str, cap: int) -> DataFrame:
    """At most ``cap`` rows, those of least md5(id): the same sample in any engine."""
    return rows.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(cap)


def capped_seeded(spark: SparkSession, rows: DataFrame, ord_col: str, n: int, cap: int) -> DataFrame:
    """At most ``cap`` of rows numbered 0 .. n - 1, as Python's generator with seed 0 samples them."""
    if n <= cap:
        return rows
    picked = random.Random(0).sample(range(n), cap)
    return rows.join(F.broadcast(spark.createDataFrame([(i,) for i in picked], "__pick long")), F.col(ord_col) == F.col("__pick")).drop("__pick")


def units(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, u): vectors of length 1; the zero vector stays zero."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("n", size).select("id", F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)).alias("u"))


def global_diversity(u: DataFrame) -> DataFrame:
    """(count, global_diversity): mean cosine distance of all ordered pairs, without making the pairs.

    The pairs' cosines sum to |sum of units|^2 - sum of |unit|^2, so one pass
    over the elements is enough at any size. Fewer than two vectors: 0.
    """
    n = u.count()
    if n < 2:
        return u.sparkSession.createDataFrame([(n, 0.0)], "count long, global_diversity double")
    sums = u.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    return total.select(F.lit(n).cast("long").alias("count"), F.round(1 - (F.col("ss") - F.col("qq")) / (n * (n - 1)), 6).alias("global_diversity"))


#: Elements of the vectors that are sent to every task whole, at most.
BLOCK_VALUES = 1 << 22


def local_diversity(u: DataFrame, k: int = 10) -> DataFrame:
    """(count, local_diversity): mean over rows of the mean distance to their min(k, n - 1) nearest.

    All pairs are compared, so the input is meant to be capped first. Up to
    BLOCK_VALUES elements, each task multiplies its rows with all of them as
    matrices; more rows are joined with each other.
    """
    n = u.count()
    if n < 2:
        return u.sparkSession.createDataFrame([(n, 0.0)], "count long, local_diversity double")
    dims = u.agg(F.min(F.size("u")).alias("least"), F.max(F.size("u")).alias("most")).first()
    if dims["least"] == dims["most"] and n * dims["most"] <= BLOCK_VALUES:
        near = _nearest_by_blocks(u, k)
    else:
        other = u.toDF("j", "w")
        far = 1 - F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        pairs = u.crossJoin(other).filter("id <> j").select("id", "j", far.alias("d"))
        near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "j"))).filter(F.col("r") <= k).groupBy("id").agg(F.avg("d").alias("m"))
    return near.agg(F.lit(n).cast("long").alias("count"), F.round(F.avg("m"), 6).alias("local_diversity"))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _nearest_by_blocks(u: DataFrame, k: int) -> DataFrame:
    """(m): each row's mean distance to its nearest others."""
    every = u.toArrow().combine_chunks()
    share = u.sparkSession.sparkContext.broadcast((every["id"].to_pylist(), _matrix(every["u"].combine_chunks())))

    def run(it):
        ids, x = share.value
        place = {i: at for at, i in enumerate(ids)}
        for batch in it:
            d = 1 - _matrix(batch.column("u")) @ x.T
            d[np.arange(len(d)), [place[i] for i in batch.column("id").to_pylist()]] = np.inf
            most = min(k, len(ids) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.partition(d, most - 1, axis=1)[:, :most].mean(1))], ["m"])

    return u.repartition(u.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "m double")
