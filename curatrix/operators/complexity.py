"""Relative complexity: batch schedules, mean scores and Elo ratings."""

from __future__ import annotations

import random
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K_FACTOR, BASE, START, MISSING = 16, 400, 1000.0, 5.0


def batches(n: int, batch_size: int, appearances: int) -> list[tuple[int, int, int, int]]:
    """(pass, batch, place, row number): every row once a pass, shuffled; a trailing single row joins the batch before."""
    rng, out = random.Random(0), []
    for p in range(max(1, appearances)):
        order = list(range(n))
        rng.shuffle(order)
        cut = [order[i : i + batch_size] for i in range(0, n, batch_size)]
        if len(cut) >= 2 and len(cut[-1]) < 2:
            single = cut.pop()
            cut[-1] += single
        out += [(p, b, k, row) for b, rows in enumerate(cut) if len(rows) >= 2 for k, row in enumerate(rows)]
    return out


def schedule(spark: SparkSession, n: int, batch_size: int, appearances: int) -> DataFrame:
    return spark.createDataFrame(batches(n, batch_size, appearances), "pass int, batch int, place int, ord long")


def portable_schedule(rows: DataFrame, ord_col: str, batch_size: int, appearances: int) -> DataFrame:
    """A schedule of the same shape from md5 order instead of a seeded shuffle: no list of rows on the driver.

    A row's place is its place within a slice of the md5s plus the sizes of the
    slices before, so no task sorts all rows.
    """
    n = rows.count()
    passes = F.explode(F.sequence(F.lit(0), F.lit(max(1, appearances) - 1)))
    keyed = rows.select(F.col(ord_col).alias("ord"), passes.alias("pass"))
    keyed = keyed.withColumn("md5", F.md5(F.concat_ws(":", "pass", "ord"))).withColumn("slice", F.substring("md5", 1, 3))
    before = Window.partitionBy("pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = keyed.groupBy("pass", "slice").count().select("pass", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.row_number().over(Window.partitionBy("pass", "slice").orderBy("md5", "ord")) - 1
    placed = keyed.join(F.broadcast(start), ["pass", "slice"]).withColumn("at", at)  # 4,096 slices a pass
    last = n // batch_size - 1 if n % batch_size == 1 and n > batch_size else n // batch_size
    out = placed.select("pass", F.least(F.floor(F.col("at") / batch_size), F.lit(last)).cast("int").alias("batch"), F.col("at").cast("int").alias("place"), "ord")
    return out if n > 1 else out.limit(0)


def raw_scores(scored: DataFrame) -> DataFrame:
    """(id, raw_score): mean score; a missing score counts as 5."""
    return scored.groupBy("id").agg(F.round(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(MISSING))), 6).alias("raw_score"))


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """Elo updates of one batch, pair by pair in order of place."""
    frame = frame.sort_values("place", kind="stable")
    ids, score, rating = list(frame["id"]), dict(zip(frame["id"], frame["score"])), dict(zip(frame["id"], frame["elo"]))
    for a, b in combinations(dict.fromkeys(ids), 2):
        expected = 1 / (1 + 10 ** ((rating[b] - rating[a]) / BASE))
        actual = 1.0 if score[a] > score[b] else 0.0 if score[a] < score[b] else 0.5
        rating[a] += K_FACTOR * (actual - expected)
        rating[b] -= K_FACTOR * (actual - expected)
    return pd.DataFrame({"id": list(rating), "elo": list(rating.values())})


def elo(rows: DataFrame, plan: DataFrame, passes: int, id_type: str = "long") -> DataFrame:
    """(id, elo) of rows (ord, id, score) under a schedule.

    Within a pass no row is in two batches, so a pass's batches are independent
    groups; only the passes follow each other. A schedule that has scores of
    its own (a row may be judged anew in each batch) overrides the rows'.
    """
    rated = rows.select("ord", "id", F.coalesce(F.col("score").cast("double"), F.lit(MISSING)).alias("score")).withColumn("elo", F.lit(START))
    judged = F.coalesce(F.col("judged").cast("double"), F.lit(MISSING)) if "score" in plan.columns else F.col("score")
    plan = plan.withColumnRenamed("score", "judged")
    for p in range(passes):
        own = rated.join(plan.filter(F.col("pass") == p).drop("pass", "id"), "ord").select("batch", "place", "id", judged.alias("score"), "elo")
        after = own.groupBy("batch").applyInPandas(_fold, f"id {id_type}, elo double").withColumnRenamed("elo", "new")
        rated = rated.join(after, "id", "left").select("ord", "id", "score", F.coalesce("new", "elo").alias("elo"))
    return rated.select("id", F.round("elo", 6).alias("elo"))
