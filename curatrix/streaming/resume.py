"""Appending rows as they arrive, once each, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import _exists


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "attempt_index") -> DataFrame:
    """Append to ``target`` the JSON-lines rows under ``source`` that it lacks by key; gives the table.

    Runs over what is there and stops. The checkpoint keeps a file from being
    read twice, the anti-join keeps a row that came twice from being stored
    twice, also where a batch is repeated after a failure.
    """

    def store(batch: DataFrame, _: int) -> None:
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if _exists(spark, target):
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def checkpoint_counts(rows: DataFrame, every: int) -> DataFrame:
    """(checkpoint, attempted, accepted): running counts after each ``every`` attempts, in order of attempt."""
    step = rows.select((F.floor(F.col("attempt_index") / every) + 1).cast("long").alias("checkpoint"), "accepted").groupBy("checkpoint").agg(F.count("*").alias("n"), F.count_if("accepted").alias("a"))
    from pyspark.sql import Window

    w = Window.orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    return step.select("checkpoint", F.sum("n").over(w).alias("attempted"), F.sum("a").over(w).alias("accepted"))
