"""Cost and call-log roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(calls: DataFrame) -> DataFrame:
    """One row per (role, task, model) and a last one of totals, by one grouping-sets pass over the call log."""
    sums = [F.count("*").alias("calls"), F.sum("in_tokens").alias("input_tokens"), F.sum("out_tokens").alias("output_tokens"), F.round(F.sum("duration_seconds"), 3).alias("duration_seconds")]
    sets = calls.groupingSets([["role", "task", "model"], []], "role", "task", "model").agg(*sums, F.grouping_id().alias("g"))
    return sets.filter("g = 0 or calls > 0").withColumn("is_total", F.col("g") > 0).drop("g")


def average_call_time(calls: DataFrame, tasks: list[str]) -> DataFrame:
    """(task, avg_seconds): duration over max(1, calls) of the given tasks."""
    return calls.filter(F.col("task").isin(tasks)).groupBy("task").agg(F.round(F.sum("duration_seconds") / F.greatest(F.lit(1), F.count("*")), 6).alias("avg_seconds"))
