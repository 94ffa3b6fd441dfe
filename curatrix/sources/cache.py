"""Embedding cache: a Parquet table (key, embedding) with misses by anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.diversity import cache_misses
from .files import _exists


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "key string, embedding array<float>")


def embed(spark: SparkSession, texts: DataFrame, path: str, model: str, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeddings of ``texts`` (text), through the cache: ``embedder`` gets only misses (key, text) and gives (key, embedding)."""
    embedder(cache_misses(texts, read(spark, path), model)).select("key", "embedding").write.mode("append").parquet(path)
    return read(spark, path)
