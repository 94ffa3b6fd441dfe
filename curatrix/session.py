"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "curatrix", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes: a Python worker holds one or two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def trim() -> None:
    """Give a Python worker's freed memory back: workers are reused, and what they hold on to adds up in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir, or in local mode a folder of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _folders:
            _folders[sc.applicationId] = tempfile.mkdtemp(prefix="curatrix-")
        where = _folders[sc.applicationId]
    return where


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _stages.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stages: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` made: for when the results that depend on them are saved."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _stages:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages.pop())
        path.getFileSystem(conf).delete(path, True)
