"""Browse-time queries over dataset rows: filter, page, summary, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import attempt_index


def apply_filters(rows: DataFrame, needle: str = "", strategy: str | None = None, accepted_only: bool = False) -> DataFrame:
    """Rows that are accepted (if asked), of the strategy (if given), and hold the needle in record, strategy or prompt, in any case."""
    if accepted_only:
        rows = rows.filter("accepted")
    if strategy:
        rows = rows.filter(F.col("strategy_id") == strategy)
    if needle := needle.strip().lower():
        rows = rows.filter(F.contains(F.lower(F.concat_ws("\n", "record", "strategy_id", "meta_prompt")), F.lit(needle)))
    return rows


def page(rows: DataFrame, number: int, order: str, size: int = 10) -> DataFrame:
    """The page of that number (from 0), the last one where there are fewer; with the range label '11-20 of 35'."""
    total = rows.count()
    number = max(0, min(number, (total - 1) // size if total else 0))
    label = f"{number * size + 1 if total else 0}-{min(total, (number + 1) * size)} of {total}"
    return rows.orderBy(order).offset(number * size).limit(size).withColumn("range_label", F.lit(label))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if("accepted").alias("accepted"), F.countDistinct("strategy_id").alias("strategies"), F.countDistinct("generator_model").alias("models"))


def strategy_options(rows: DataFrame) -> DataFrame:
    return rows.select("strategy_id").distinct().orderBy("strategy_id")


def with_strategy(rows: DataFrame, strategies: DataFrame) -> DataFrame:
    """Rows with their strategy's description; null where it is unknown."""
    return rows.join(strategies.select(F.col("id").alias("strategy_id"), F.col("description").alias("strategy_description")), "strategy_id", "left")


def pending(attempts: DataFrame, done: DataFrame) -> DataFrame:
    """Attempts without a completed row; the row's number may be in its id only."""
    have = done.select(attempt_index(F.col("attempt_index"), F.col("id")).alias("attempt_index")).filter("attempt_index is not null").distinct()
    return attempts.join(have, "attempt_index", "left_anti")
