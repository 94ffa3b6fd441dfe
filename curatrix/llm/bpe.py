"""Byte-level BPE encoding of whole texts, in parallel within long ones, and decoding.

Texts up to ``chunk`` characters are encoded as they stand. A longer text is
cut into chunks that overlap by ``overlap`` characters. Chunks are
pre-tokenised apart from each other, in parallel; where two neighbours have a
pre-token boundary in common within their overlap, both scans are in the same
state and go on alike, so the text is stitched there. Pieces between stitches
are encoded in parallel, and their tokens put together in order.

A boundary counts only if it is not near its chunk's end, where the scan has
not seen what follows. A chunk that has no boundary in common with the one
before (a run of letters longer than the overlap, say) is joined to it, and so
is all that follows in that text: nothing vouches for those scans, and one
scan of the joined piece is exact.

Decoding puts together the tokens' raw bytes.

Defined results: null text has null tokens and n_tokens 0; empty text has an
empty list. Equal rows get equal results. Rows are told apart by
(doc_id, text), so repeated rows are encoded once and each get the result. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .chat import tokenizer

CHUNK = 32768
OVERLAP = 512
#: Characters before a chunk's end whose boundaries may change with what follows.
MARGIN = 4


def pretokens(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text``, in characters."""
    return [m.end() for m in _compiled(pattern).finditer(text)]


_patterns: dict = {}


def _compiled(pattern: str):
    import regex

    if pattern not in _patterns:
        _patterns[pattern] = regex.compile(pattern)
    return _patterns[pattern]


def default_pattern() -> str:
    import public_tokenizers as public

    return public.PATTERN


def cut(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of the chunks of a text; each but the last overlaps the next one."""
    step, out, at = chunk - overlap, [], 0
    while True:
        out.append((at, min(length, at + chunk)))
        if at + chunk >= length:
            return out
        at += step


def _chunk_rows(chunk: int, overlap: int, pattern: str):
    """(key, k, start, text) rows to (key, k, start, text, head, tail): boundaries in the two overlaps, by position in the text."""

    def run(it):
        for batch in it:
            heads, tails = [], []
            for start, text, last in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist(), batch.column("last").to_pylist()):
                # A piece must end as the text goes on; white space at its end would be split otherwise.
                ends = np.array([e for e in pretokens(text, pattern) if not text[e - 1].isspace()], np.int64)
                sure = ends[ends <= len(text) - MARGIN] if not last else ends
                heads.append((start + sure[sure <= overlap]).tolist() if start else [])
                tails.append((start + sure[sure > len(text) - overlap]).tolist() if not last else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    return run


def _encode_column(vocabulary: str | None):
    def run(texts: pa.Array) -> pa.Array:
        enc = tokenizer(vocabulary)
        ids = [np.asarray(enc.encode_ordinary(t.as_py()), np.int32) if t.is_valid else None for t in texts]
        offs = np.r_[0, np.cumsum([0 if i is None else len(i) for i in ids])].astype(np.int32)
        flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
        mask = pa.array([i is None for i in ids], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()), mask=mask)

    return F.arrow_udf(run, "array<int>")


def _decode_column(vocabulary: str | None):
    def run(ids: pa.Array) -> pa.Array:
        enc = tokenizer(vocabulary)
        out = [enc.decode_bytes(np.asarray(i.values).tolist()).decode("utf-8", "replace") if i.is_valid else None for i in ids]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def decode(rows: DataFrame, column: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with the text that the tokens stand for in ``decoded``."""
    common.tune(rows.sparkSession)
    return rows.withColumn("decoded", _decode_column(vocabulary)(F.col(column)))


def pieces(docs: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(key, piece, at, text): stitched pieces of the texts of ``docs`` (key, text), in order of ``at``."""
    spark = docs.sparkSession
    size = F.length("text")
    step = chunk - overlap
    count = F.greatest(F.lit(1), F.ceil((size - overlap) / F.lit(step)).cast("int"))
    each = docs.select("key", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), (count - 1).alias("most"))
    each = each.select("key", "k", (F.col("k") * step).cast("long").alias("start"), (F.col("k") == F.col("most")).alias("last"), F.substring(F.col("text"), F.col("k") * step + 1, F.lit(chunk)).alias("piece"))
    spread = each.repartition(2 * common.parts(spark), "key", "k")
    scanned = common.written(spread.mapInArrow(_chunk_rows(chunk, overlap, pattern), "key long, k int, start long, last boolean, piece string, head array<long>, tail array<long>"))
    order = Window.partitionBy("key").orderBy("k")
    meta = scanned.select("key", "k", "start", "last", F.array_min(F.array_intersect("head", F.lag("tail").over(order))).alias("stitch"))
    # Scans are vouched for up to the first chunk without a stitch; from there on the text is one piece.
    lost = F.max(F.when((F.col("k") > 0) & F.col("stitch").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    opens = ((F.col("k") == 0) | ((lost == 0) & F.col("stitch").isNotNull())).cast("int")
    meta = meta.withColumn("opens", opens).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    meta = meta.withColumn("from", F.when(F.col("k") == 0, F.lit(0)).when(F.col("opens") == 1, F.col("stitch"))).withColumn("next", F.lead(F.struct("opens", "from")).over(order))
    until = F.when(F.col("next.opens") == 1, F.col("next.from"))
    # A chunk gives its text from its stitch, or from the end of the chunk before, to the next stitch or its own end.
    begin = F.when(F.col("opens") == 1, F.col("from")).otherwise(F.col("start") + overlap)
    meta = meta.select("key", "k", "group", begin.alias("begin"), until.alias("until"))
    parts = scanned.join(meta, ["key", "k"])
    own_end = F.col("start") + F.length("piece")
    text = F.substring(F.col("piece"), (F.col("begin") - F.col("start") + 1).cast("int"), (F.coalesce("until", own_end) - F.col("begin")).cast("int"))
    return parts.select("key", "group", "k", text.alias("text")).groupBy("key", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))


def encode(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, tokens, n_tokens) of every document."""
    return _encoded(docs, chunk, overlap, vocabulary, pattern).drop("digest")


def _encoded(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, digest, tokens, n_tokens) of every document; ``digest`` is its text's md5."""
    spark = common.tune(docs.sparkSession)
    code = _encode_column(vocabulary)
    texts = docs.select("doc_id", "text", common.row_key().alias("key"), F.md5(F.encode("text", "utf-8")).alias("digest"))
    big = F.length("text") > chunk
    short = texts.filter(~F.coalesce(big, F.lit(False))).select("doc_id", "digest", code(F.col("text")).alias("tokens"))
    whole = texts.filter(big)
    long_ = common.written(pieces(whole.dropDuplicates(["key"]).select("key", "text"), chunk, overlap, pattern or default_pattern()).repartition(2 * common.parts(spark)).select("key", "group", code(F.col("text")).alias("tokens")))
    joined = long_.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    rest = whole.select("doc_id", "key", "digest").join(joined, "key").select("doc_id", "digest", "tokens")
    return short.unionByName(rest).withColumn("n_tokens", F.coalesce(F.size("tokens"), F.lit(0)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded, same) of every document: its tokens, the text they decode to, and whether that is its own."""
    coded = decode(_encoded(common.table(spark, sf_dir, "documents")))
    return coded.withColumn("same", F.md5(F.encode("decoded", "utf-8")).eqNullSafe(F.col("digest"))).drop("digest")
