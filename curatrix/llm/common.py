"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Rows per Arrow batch for tables of texts: the Python side of a task holds one batch.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes, and see that checkpoints have a folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local["):
            if sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="curatrix-")
        where = _own[sc.applicationId]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables that ``written`` made, but for those that ``keep`` reads: nothing else may still depend on them."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in keep for f in df.inputFiles()}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table_ in [t for t in _tables if t.rsplit("/", 1)[1] not in kept]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_)
        path.getFileSystem(conf).delete(path, True)
        _tables.remove(table_)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64-bit identity of a document: rows with equal id and equal text are one document listed more than once."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df``, written, with each row's place (from 0) in a total order, which no single task ever sees.

    Rows are range-partitioned and sorted within partitions; a row's place is
    the number of rows in the partitions before it and its place in its own.
    """
    spark = df.sparkSession
    (at, part, start) = fresh(df, "at", "part", "start")
    spread = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    rows = written(spread.withColumn(at, F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n")).collect()
    total, starts = 0, []
    for r in sorted(sizes, key=lambda r: r[part]):
        starts.append((r[part], total))
        total += r["n"]
    # One row for each partition.
    before = F.broadcast(spark.createDataFrame(starts, f"{part} long, {start} long"))
    joined = rows.withColumn(part, F.shiftright(at, 33)).join(before, part)
    return joined.withColumn(name, F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, part, start)


def integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType))


def id_numbers(df: DataFrame, column: str) -> DataFrame | None:
    """(id, number) of the distinct ids that are not null, in their order; None where the ids are integers themselves."""
    if integral(df, column):
        return None
    ids = df.select(F.col(column).alias("id")).filter("id is not null").distinct()
    return written(numbered(ids, F.col("id").asc(), name="number"))


def placed(df: DataFrame, shard: str, shards: int, *order: Column) -> DataFrame:
    """``df`` with every shard (0 to ``shards`` - 1) whole in one task, shards spread evenly, sorted by shard and ``order`` within a task."""
    tasks = min(shards, 16 * parts(df.sparkSession))
    task = F.floor(F.col(shard) * F.lit(tasks) / F.lit(shards)).cast("int")
    return df.repartitionById(tasks, task).sortWithinPartitions(shard, *order)


def met(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table | None, pa.RecordBatch | None]]:
    """(shard, home rows, None) for each shard of ``placed`` rows, then (shard, None, asks) for each batch of its asks.

    Rows have ``shard`` and ``asks`` (false first): only the home rows are held.
    """
    shard, home = None, []
    for batch in it:
        number, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        step = number.astype(np.int64) * 2 + asks
        cut = np.r_[np.flatnonzero(np.r_[True, step[1:] != step[:-1]]), len(step)] if len(step) else np.zeros(1, np.int64)
        for a, b in zip(cut, cut[1:]):
            if number[a] != shard:
                shard, home = int(number[a]), []
            if not asks[a]:
                home.append(batch.slice(a, b - a))
                continue
            if isinstance(home, list):
                if home:
                    yield shard, pa.Table.from_batches(home), None
                home = bool(home)
            if home:
                yield shard, None, batch.slice(a, b - a)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


#: Bytes of files and number of rows of a table that is broadcast, at most.
SIDE_BYTES, SIDE_ROWS = 4 << 20, 1_000_000


def side(df: DataFrame, most_bytes: int = SIDE_BYTES, most_rows: int = SIDE_ROWS) -> DataFrame:
    """``df`` (a written table) as a join side: broadcast up to ``most_bytes`` of files and ``most_rows``, else shuffled."""
    conf, jvm, size = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm, 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
        if size > most_bytes:
            return df
    return F.broadcast(df) if df.count() <= most_rows else df


def bitmap(df: DataFrame, column: str, rows: int, most_bits: int = 28) -> np.ndarray:
    """Packed bitmap of a 64-bit hash column: a filter without false negatives.

    It has some 16 bits a value, and 2**most_bits (32 MB) at most: with more
    values than that it lets more through, and is still right.
    """
    power = int(np.clip(np.ceil(np.log2(max(rows, 1) * 16)), 16, most_bits))
    width = min(power, 18)
    bit = F.shiftrightunsigned(F.col(column), 64 - power)

    def pack(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << width, np.uint8)
        out[t["bit"].to_numpy() & ((1 << width) - 1)] = 1
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    found = df.select(bit.alias("bit")).distinct().withColumn("block", F.shiftright("bit", width)).groupBy("block").applyInArrow(pack, "block long, bits binary").collect()
    full = np.zeros(1 << (power - 3), np.uint8)
    step = 1 << (width - 3)
    for r in found:
        full[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return full


def in_bitmap(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 values may be in a ``bitmap``."""
    power = int(np.log2(len(packed))) + 3
    bit = values >> np.uint64(64 - power)
    return (packed[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1


def trim() -> None:
    """Give a Python worker's freed memory back: workers are reused, and what they hold on to adds up in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives its memory back when its partition ends."""

    def wrapped(it):
        try:
            yield from run(it)
        finally:
            trim()

    return wrapped


def may_have(key: Column, marks: DataFrame, other: str) -> Column:
    """Whether a 64-bit key may be among those of ``marks`` (a written table): a bitmap of at most 32 MB tells."""
    known = marks.sparkSession.sparkContext.broadcast(bitmap(marks, other, marks.count()))

    @F.arrow_udf("boolean")
    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(known.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return marked(key)


def attach(rows: DataFrame, key: str, marks: DataFrame, other: str) -> DataFrame:
    """``rows`` left-joined with ``marks`` (a written table, one row for each 64-bit ``other``) on ``key``.

    Only rows whose key may be marked are shuffled, if any; the others, texts
    and all, stay where they are.
    """
    marked = may_have(F.col(key), marks, other)
    hit = rows.filter(marked).join(side(marks), F.col(key) == F.col(other), "left")
    rest = rows.filter(~marked)
    return hit.unionByName(rest.select("*", *[F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in marks.columns]))


def batches(make: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema) -> Callable:
    """A mapInArrow function of one that yields columns for a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for cols in make(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name] for f in schema], schema=schema)

    return lean(run)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the least node reached.

    Each round hooks every node on the least label among its neighbours and
    then jumps to that label's label; long chains take logarithmically many
    rounds. Labels and edges are checkpointed, so no round repeats another.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, label["node"] == near["a"]).select("node", F.least("root", "near").alias("next"), "root")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = hooked.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")).checkpoint()
        moved = after.filter("root <> old").limit(1).count()
        label = after.select("node", "root")
        if not moved:
            return label
