"""Packing into optimal length buckets.

A document's length is its number of words (runs without white space). The
histogram of all lengths is counted over all documents; dynamic programming
over it chooses at most ``buckets`` upper bounds so that the total padding,
each document padded to its bucket's bound, is least (of equal bounds, the
leftmost split). Inside a bucket documents stand in order of (length, doc_id,
text hash) and fill batches: as many rows as the token budget holds at the
bucket's bound.

No document is cut and none is left out: one longer than the budget is a batch
by itself. Documents are numbered in order through range partitions: a row's
place is the number of rows in the partitions before it and its place in its
own, so no task sees a whole length or bucket.

Defined results: null, empty and blank texts have length 0; their bucket's
bound may be 0, and its batches hold ``budget`` rows. Null ids come first in
their length; ids may be of any type that can be ordered. Rows with equal id
and text are packed each, in places that follow one another. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUDGET = 16384
BUCKETS = 8


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the buckets of least padding, for sorted distinct lengths and their counts.

    cost(i, j) = L[j] * (N[j + 1] - N[i]) - (S[j + 1] - S[i]) obeys the quadrangle
    inequality, so the best split moves to the right with j: each layer is
    solved by divide and conquer in O(n log n).
    """
    n = len(lengths)
    if not n:
        return []
    top = np.asarray(lengths, dtype=np.int64)
    rows = np.r_[0, np.cumsum(np.asarray(counts, dtype=np.int64))]
    total = np.r_[0, np.cumsum(top * np.asarray(counts, dtype=np.int64))]
    layers = min(buckets, n)
    best = top * rows[1:] - total[1:]
    splits = []
    for layer in range(1, layers):
        new, split = best.copy(), np.zeros(n, np.int64)
        stack = [(layer, n - 1, layer, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j, right) + 1)
            cost = best[i - 1] + top[j] * (rows[j + 1] - rows[i]) - (total[j + 1] - total[i])
            k = int(cost.argmin())
            new[j], split[j] = cost[k], i[k]
            stack.append((lo, j - 1, left, int(i[k])))
            stack.append((j + 1, hi, int(i[k]), right))
        best = new
        splits.append(split)
    out, j = [], n - 1
    for split in reversed(splits):
        out.append(int(top[j]))
        j = int(split[j]) - 1
    out.append(int(top[j]))
    return out[::-1]


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place): every document's batch within its bucket and place within that."""
    spark = common.tune(docs.sparkSession)
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")
    sized = common.written(docs.select("doc_id", common.row_key().alias("key"), n.alias("n_tokens")))
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("rows")).orderBy("n_tokens").toPandas()
    lengths, counts = histogram["n_tokens"].to_numpy(), histogram["rows"].to_numpy()
    tops = bounds(lengths, counts, buckets)
    which = np.searchsorted(tops, lengths)
    before = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
    places = [(int(x), int(b), int(tops[b]), int(before[np.searchsorted(which, b)])) for x, b in zip(lengths, which)]
    # One row for each distinct length: as many as the longest document has words, at most.
    place = F.broadcast(spark.createDataFrame(places, "n_tokens long, bucket int, bucket_length long, bucket_start long"))
    order = (F.col("n_tokens").asc(), F.col("doc_id").asc_nulls_first(), F.col("key").asc())
    joined = common.numbered(sized, *order, name="at").join(place, "n_tokens")
    rank = F.col("at") - F.col("bucket_start")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return joined.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(rank / rows).cast("long").alias("batch"), (rank % rows).alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


def oracle(source: str = "documents", budget: int = BUDGET, buckets: int = BUCKETS) -> str:
    """The same packing in SQL: the dynamic program is a chain of joins of the histogram with itself."""
    steps = ["""s as (select doc_id, hash_, len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20]+')) as n_tokens from (select doc_id, text, md5(text) as hash_ from {source}))""".format(source=source),
             "h as (select n_tokens as l, count(*) as c from s group by 1)",
             "p as (select l, row_number() over (order by l) as j, sum(c) over (order by l) as r, sum(l * c) over (order by l) as t from h)",
             "d1 as (select j, l * r - t as cost, cast([l] as bigint[]) as tops from p)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"d{k} as (select j, cost, tops from (select q.j, d.cost + q.l * (q.r - a.r) - (q.t - a.t) as cost, list_append(d.tops, cast(q.l as bigint)) as tops,"
            f" row_number() over (partition by q.j order by d.cost + q.l * (q.r - a.r) - (q.t - a.t), d.j) as rn from p q join p a on a.j < q.j join d{k - 1} d on d.j = a.j) where rn = 1)"
        )
    every = " union all ".join(f"select {k} as k, tops from d{k} where j = (select max(j) from p)" for k in range(1, buckets + 1))
    steps += [f"best as (select tops from ({every}) order by k desc limit 1)",
              "b as (select unnest(tops) as top, unnest(range(0, len(tops))) as bucket from best)",
              "w as (select s.*, (select min(top) from b where top >= n_tokens) as bucket_length from s)",
              "n as (select w.*, b.bucket, row_number() over (partition by b.bucket order by n_tokens, doc_id, hash_) - 1 as rank from w join b on b.top = w.bucket_length)"]
    return "with " + ",\n".join(steps) + f"""
select doc_id, cast(n_tokens as bigint) as n_tokens, cast(bucket as integer) as bucket, cast(bucket_length as bigint) as bucket_length,
       cast(rank // greatest(1, {budget} // greatest(bucket_length, 1)) as bigint) as batch,
       cast(rank % greatest(1, {budget} // greatest(bucket_length, 1)) as bigint) as place from n"""


ORACLE = oracle()
