"""Near-equal lines across documents: an exact set-similarity join.

A line is what newlines separate; its set is its distinct lower-case words
(runs of anything but white space). A line goes when an earlier line's set has
Jaccard similarity >= 4/5 with its own, lines being ordered by (doc_id nulls
first, text hash, line number). The earlier line need not itself stay.

The join keeps to four filters, all without false negatives, then verifies:

* **rarity order and prefix**: the words of a set are ordered by how often
  they occur in the corpus (rarest first, by a count over all documents in
  2**20 buckets); two similar sets share one of their first
  s - ceil(0.8 s) + 1 words;
* **length**: sizes differ by a factor of at most 0.8;
* **position**: the words left behind the shared one must suffice;
* **bitmap**: word signatures (128 bits, then 512) differ in no more bits than
  the sets may.

Only distinct sets are joined, so a line with a million copies counts once.
The sets of the candidates left are fetched, compared exactly and matched.

Defined results: a blank line has no set and always stays; null text stays
null, empty text stays empty. A document whose every non-blank line goes is
left out by ``keep_lines`` and has text '' in ``clean``. Rows with equal id
and text are one document listed more than once: they keep the same lines.
An empty table gives an empty result. Extra columns are kept by
``keep_lines`` and ignored otherwise. Words are told apart by 42-bit hashes
(40 bits where two sets are compared), sets by 64-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textarrays import SPACED, column, hashes, mix64, slices, words

FREQ_BITS = 20
#: Distinct sets whose prefix words a task joins, about.
SHARD_SETS = 1 << 20
_FREQ_BLOCK = 1 << 16
_MASK42 = np.uint64((1 << 42) - 1)


def _least(size: np.ndarray) -> np.ndarray:
    """ceil(0.8 * size)"""
    return (4 * size + 4) // 5


def _needed(total: np.ndarray) -> np.ndarray:
    """Least overlap of two sets with so many words together and Jaccard >= 4/5: ceil(4 total / 9)."""
    return (4 * total + 8) // 9


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Per slice of rows: (first row, line starts, row of each line, line of each word, 42-bit word hashes).

    A slice has at most 2**16 lines, so that a line's number fits beside its words' hashes.
    """
    for lo, hi in slices(offs):
        b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        at = np.r_[o[:-1], np.flatnonzero(b == 10) + 1]
        row = np.r_[np.arange(hi - lo), np.searchsorted(o, np.flatnonzero(b == 10), "right") - 1]
        by = np.lexsort((row, at))
        at, row = at[by], row[by]
        starts, ends, _ = words(b, o, SPACED)
        line = np.repeat(np.arange(len(at)), np.diff(np.r_[np.searchsorted(starts, at), len(starts)]))
        h = hashes(b, starts, ends) >> np.uint64(22)
        for first in range(0, len(at), 1 << 16):
            a, z = np.searchsorted(line, (first, first + (1 << 16)))
            last = min(len(at), first + (1 << 16))
            # a row's first line number within the slice, for numbering lines in their document
            yield lo, first, at[first:last], row, line[a:z] - first, h[a:z]


def _sets(line: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line: (line, hash), sorted."""
    key = np.sort((line.astype(np.uint64) << np.uint64(42)) | h)
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(42)).astype(np.int64), key & _MASK42


def _names(line: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first word, set hash) of the non-blank lines; words come sorted by line."""
    if not len(line):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    return line[first], first, np.add.reduceat(mix64(h + np.uint64(1)), first)


def _numbers(row: np.ndarray, first: int, count: int) -> np.ndarray:
    """Number of each line within its document."""
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    start = np.repeat(head, np.diff(np.r_[head, len(row)]))
    return (np.arange(len(row)) - start)[first : first + count]


def _survey(it):
    """Every line's set and place, and the task's word counts by bucket, in one pass."""
    total, id_type = np.zeros(1 << FREQ_BITS, np.int32), pa.int64()
    for batch in it:
        id_type = batch.column("doc").type
        buf, offs = column(pc.utf8_lower(batch.column("text")))
        doc, key = batch.column("doc"), batch.column("key")
        for lo, base, at, row, line, h in _lines(buf, offs):
            bucket = np.sort(h & np.uint64((1 << FREQ_BITS) - 1)).astype(np.int64)
            if len(bucket):
                new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                total[bucket[new]] += np.diff(np.r_[new, len(bucket)]).astype(np.int32)
            lines, _, name = _names(*_sets(line, h))
            n, take = len(lines), pa.array(lo + row[base + lines])
            number = _numbers(row, base, len(at))[lines].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), doc.take(take), key.take(take), pa.array(number), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["s", "doc", "key", "line", "block", "counts"])
    n = (1 << FREQ_BITS) // _FREQ_BLOCK
    blobs = pa.array([total[i * _FREQ_BLOCK : (i + 1) * _FREQ_BLOCK].tobytes() for i in range(n)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), blobs], ["s", "doc", "key", "line", "block", "counts"])


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """log2 of the corpus count of each word bucket, in half steps (uint8, 2**FREQ_BITS of them)."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_FREQ_BLOCK, np.int64)
        for v in t["counts"]:
            total += np.frombuffer(v.as_py(), np.int32)
        level = np.where(total > 0, np.minimum(2 * np.log2(np.maximum(total, 1)), 62) + 1, 0).astype(np.uint8)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(1 << FREQ_BITS, np.uint8)
    for r in surveyed.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, level binary").collect():
        out[r["block"] * _FREQ_BLOCK : (r["block"] + 1) * _FREQ_BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


_ENTRY = np.dtype([("set", "u8"), ("sign", "u8"), ("more", "u8"), ("word", "u4"), ("size", "u2"), ("pos", "u2")])
_WIDE = np.dtype([("set", "u8"), ("sign", "u8"), ("more", "u8"), ("word", "u4"), ("size", "u4"), ("pos", "u4")])


def entries(line: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(full word hash, entry) for the prefix words of the lines' sets, from the lines and hashes of all words."""
    if not len(line):
        return np.zeros(0, np.uint64), np.zeros(0, _ENTRY)
    rare = level[(h & np.uint64((1 << FREQ_BITS) - 1)).astype(np.int32)].astype(np.uint64)
    # line (16 bits) | rarity (6) | hash (42): one sort gives each set's words from rare to frequent
    key = np.sort((line.astype(np.uint64) << np.uint64(48)) | (rare << np.uint64(42)) | h)
    key = key[np.r_[True, key[1:] != key[:-1]]]
    of, h = (key >> np.uint64(48)).astype(np.int32), key & _MASK42
    _, first, name = _names(of, h)
    size = np.diff(np.r_[first, len(of)])
    mixed = mix64(h)
    bit, second = np.uint64(1) << (mixed >> np.uint64(58)), (mixed & np.uint64(1)).astype(bool)
    sign = np.bitwise_or.reduceat(np.where(second, np.uint64(0), bit), first)
    more = np.bitwise_or.reduceat(np.where(second, bit, np.uint64(0)), first)
    # Sets of up to 3 words are similar to no set but themselves.
    count = np.where(size > 3, size - _least(size) + 1, 0)
    rank = np.repeat(np.arange(len(size)), count)
    pos = np.arange(len(rank)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    word = h[first[rank] + pos]
    out = np.empty(len(rank), _ENTRY if size.max() < 65536 else _WIDE)
    out["set"], out["sign"], out["more"], out["size"], out["pos"] = name[rank], sign[rank], more[rank], size[rank], pos
    out["word"] = (word >> np.uint64(10)) & np.uint64(0xFFFFFFFF)
    return word, out


def candidates(e: np.ndarray):
    """Chunks of set-name pairs and their signatures' difference (a, b, gap), a < b, that pass all filters, from the entries of some words."""
    size = e["size"].astype(np.int64)
    # The last bits put equal sets side by side; those that collide there are told apart below.
    wide = size.max(initial=0) >= 65536
    o = np.lexsort((e["set"], size, e["word"])) if wide else np.argsort((e["word"].astype(np.uint64) << np.uint64(32)) | (size.astype(np.uint64) << np.uint64(16)) | (e["set"] & np.uint64(0xFFFF)))
    word, name, sign, more, size, pos = e["word"][o], e["set"][o], e["sign"][o], e["more"][o], size[o].astype(np.int32), e["pos"][o].astype(np.int32)
    if len(o):
        new = np.r_[True, (word[1:] != word[:-1]) | (name[1:] != name[:-1])]
        word, name, sign, more, size, pos = word[new], name[new], sign[new], more[new], size[new], pos[new]
    group = np.cumsum(np.r_[False, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    by = group * (1 << 33) + size
    # Length filter, and the position filter as far as it depends on the smaller set: 4 (a + b) / 9 <= a - pos.
    most = np.minimum(size.astype(np.int64) * 5 // 4, 9 * (size.astype(np.int64) - pos) // 4 - size)
    many = np.maximum(np.searchsorted(by, group * (1 << 33) + most, "right") - np.arange(len(by)) - 1, 0)
    left = size - pos
    ends = np.cumsum(many)
    lo = 0
    while lo < len(by):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 18), "right")))
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi, dtype=np.int32), n)
        j = np.arange(len(i), dtype=np.int32) + np.repeat((np.arange(lo, hi) + 1 - np.r_[0, np.cumsum(n)[:-1]]).astype(np.int32), n)
        lo = hi
        total = size[i] + size[j]
        ok = 9 * left[j] >= 4 * total
        i, j, total = i[ok], j[ok], total[ok]
        spare = total - 2 * _needed(total)
        gap = np.bitwise_count(sign[i] ^ sign[j])
        ok = gap <= spare
        i, j, gap, spare = i[ok], j[ok], gap[ok], spare[ok]
        gap = gap + np.bitwise_count(more[i] ^ more[j])
        a, b = name[i], name[j]
        ok = (gap <= spare) & (a != b)
        if ok.any():
            a, b = a[ok], b[ok]
            yield np.minimum(a, b), np.maximum(a, b), gap[ok]


_PAIR = np.dtype([("a", "u8"), ("b", "u8"), ("gap", "u1")])


def _unique_pairs(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts) if parts else np.zeros(0, _PAIR)
    x = x[np.lexsort((x["b"], x["a"]))]
    return x[np.r_[True, (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])]] if len(x) else x


_PAIR_BLOB = "part int, pairs binary"


def _pair_rows(parts: list[np.ndarray], spread: int) -> pa.RecordBatch:
    """Distinct pairs as one blob for each part of the first name's hash range."""
    x = _unique_pairs(parts)
    part = ((x["a"] >> np.uint64(32)) * np.uint64(spread) >> np.uint64(32)).astype(np.int32)  # x is sorted, so is this
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
    blobs = [x[i:j].tobytes() for i, j in zip(cut, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]] if blobs else [], pa.int32()), pa.array(blobs, pa.binary())], ["part", "pairs"])


def _gather(it):
    """A partition's distinct pairs as rows."""
    x = _unique_pairs([np.frombuffer(v.as_py(), _PAIR) for batch in it for v in batch.column("pairs")])
    for lo in range(0, len(x), 1 << 16):
        y = x[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(y["a"].astype(np.int64)), pa.array(y["b"].astype(np.int64)), pa.array(y["gap"].astype(np.int32))], ["a", "b", "gap"])


def _joiner(spread: int):
    def join(it):
        """Candidate pairs of a partition's words."""
        got = [np.frombuffer(blob.as_py(), _WIDE if wide.as_py() else _ENTRY) for batch in it for blob, wide in zip(batch.column("entries"), batch.column("wide"))]
        if not got:
            return
        e = np.concatenate([x.astype(_WIDE) for x in got] if any(x.dtype == _WIDE for x in got) else got)
        del got
        parts, held = [], 0
        for a, b, gap in candidates(e):
            pairs = np.empty(len(a), _PAIR)
            pairs["a"], pairs["b"], pairs["gap"] = a, b, gap
            parts.append(pairs)
            held += len(a)
            if held > 1 << 20:
                yield _pair_rows(parts, spread)
                parts, held = [], 0
        yield _pair_rows(parts, spread)

    return join


def removals(docs: DataFrame) -> DataFrame:
    """(key, lines): the numbers of the lines that go, per document key."""
    spark = common.tune(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.col("doc_id").alias("doc"), common.row_key().alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    surveyed = common.written(texts.mapInArrow(common.lean(_survey), f"s long, doc {id_type}, key long, line int, block int, counts binary"))
    level = spark.sparkContext.broadcast(frequencies(surveyed))
    places = surveyed.filter("s is not null").select("s", "doc", "key", "line")
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "key", "line")
    # Minimum and maximum are aggregated before they are shuffled, however many copies a line has; the rows of a repeated document are one place.
    firsts = common.written(places.groupBy("s").agg(F.min(place).alias("f"), F.max(place).alias("l")))
    shards = max(12, common.parts(spark), firsts.count() // SHARD_SETS)

    def index(it):
        for batch in it:
            buf, offs = column(pc.utf8_lower(batch.column(0)))
            for _, _, _, _, line, h in _lines(buf, offs):
                word, e = entries(line, h, level.value)
                shard = (mix64(word) >> np.uint64(32)).astype(np.int64) % shards
                o = np.argsort(shard.astype(np.int32), kind="stable")
                shard, e = shard[o], e[o]
                cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(o)] if len(o) else np.zeros(1, np.int64)
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]].astype(np.int32) if n else [], pa.int32()), pa.array([e.dtype == _WIDE] * n, pa.bool_()), pa.array([e[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["shard", "wide", "entries"])

    found = common.written(_candidate_pairs(texts, index, shards))
    common.release(spark)
    confirmed = _confirmed(texts, found, firsts).withColumn("all", F.lit(True))
    marks = common.written(firsts.join(confirmed, "s", "left").filter(F.col("all") | (F.col("f") != F.col("l"))).select("s", "f", "all"))
    # Most lines are told by a bitmap to have no mark, and are not shuffled.
    gone = places.filter(common.may_have(F.col("s"), marks, "s")).join(common.side(marks), "s").filter(F.coalesce("all", F.lit(False)) | (place != F.col("f")))
    return gone.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _candidate_pairs(texts: DataFrame, index, shards: int) -> DataFrame:
    """(a, b, gap): the distinct candidate pairs of set names."""
    entries_ = texts.select("text").mapInArrow(common.lean(index), "shard int, wide boolean, entries binary").repartition(shards, "shard")
    return entries_.mapInArrow(common.lean(_joiner(shards)), _PAIR_BLOB).repartition(shards, "part").mapInArrow(common.lean(_gather), "a long, b long, gap int")


def _confirmed(texts: DataFrame, found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(s): the sets that are similar to one with an earlier first line.

    A set needs one such partner, so the earlier candidate of closest signature
    is compared first, and only the sets that this doesn't settle have all
    their other candidates compared, after a filter by longer signatures.
    """
    some = found.select(F.col("a").alias("s")).union(found.select(F.col("b").alias("s"))).distinct()
    heads = common.written(firsts.join(some, "s", "left_semi").select("s", "f.doc", "f.key", "f.line"))
    both = found.join(heads.toDF("a", "da", "ka", "la"), "a").join(heads.toDF("b", "db", "kb", "lb"), "b")
    at = lambda x: F.struct(F.col(f"d{x}").isNotNull(), f"d{x}", f"k{x}", f"l{x}")
    swap = at("a") < at("b")
    ask = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("t"), "gap")
    order = Window.partitionBy("s").orderBy("gap", "t")
    ask = common.written(ask.withColumn("first", F.row_number().over(order) == 1).select("s", "t", "first"))
    common.release(texts.sparkSession)
    sets = common.written(_sets_of(texts, heads))
    common.release(texts.sparkSession)
    settled = common.written(_compare(ask.filter("first").select("s", "t"), sets).filter("same").select("s"))
    others = ask.filter("not first").join(common.side(settled), "s", "left_anti").select("s", "t")
    close = common.written(_close(others, sets))
    return settled.union(_compare(close, sets).filter("same").select("s")).distinct()


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` that ``pairs`` (s, t) name."""
    return sets.join(common.side(common.written(pairs.select("s").union(pairs.select("t")).distinct())), "s", "left_semi")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose long signatures allow a Jaccard similarity >= 4/5."""
    signs = _only(sets, pairs).select("s", F.expr(f"length(set) div {_WORD_BYTES}").alias("n"), "w")
    apart = sum((F.bit_count(F.col("w")[i].bitwiseXOR(F.col("v")[i])) for i in range(_SIGN_WORDS)), F.lit(0))
    both = pairs.join(signs, "s").join(signs.toDF("t", "m", "v"), "t")
    return both.filter(apart <= F.expr("n + m - 2 * ((4 * (n + m) + 8) div 9)")).select("s", "t")


_SIGN_WORDS = 8
#: Bytes of a word's hash in a set that is sent for comparison.
_WORD_BYTES = 5


def _long_sign(h: np.ndarray) -> np.ndarray:
    """512-bit signature of a set's words, as 64-bit integers."""
    bits = np.zeros(64 * _SIGN_WORDS, np.uint8)
    bits[(mix64(h) >> np.uint64(64 - 9)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _sets_of(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(s, set): the words of the sets in ``heads``, from the documents that have their first lines."""
    spark = texts.sparkSession
    wanted = spark.sparkContext.broadcast(common.bitmap(heads, "s", heads.count()))
    holders = common.written(heads.select(F.col("key")).distinct())

    def fetch(it):
        for batch in it:
            buf, offs = column(pc.utf8_lower(batch.column(0)))
            for _, _, _, _, line, h in _lines(buf, offs):
                line, h = _sets(line, h)
                _, first, name = _names(line, h)
                ok = np.flatnonzero(common.in_bitmap(wanted.value, name)) if len(name) else first
                stop = np.r_[first[1:], len(line)]
                _, one = np.unique(name[ok], return_index=True)
                ok = ok[one]
                got = [h[first[k] : stop[k]] for k in ok]
                signs = [_long_sign(g).tolist() for g in got]
                yield pa.RecordBatch.from_arrays([pa.array(name[ok].view(np.int64)), pa.array([_packed(g) for g in got], pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["s", "set", "w"])

    # A document more does no harm.
    kept = texts.filter(common.may_have(F.col("key"), holders, "key")).select("text")
    return kept.mapInArrow(common.lean(fetch), "s long, set binary, w array<long>").dropDuplicates(["s"])


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _WORD_BYTES, 8), np.uint8)
    out[:, :_WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _WORD_BYTES)
    return out.view(np.uint64)[:, 0]


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, same): whether the two sets of each pair (s, t) have Jaccard similarity >= 4/5."""
    used = _only(sets, pairs).select("s", "set")
    # No column is renamed below a join, so that both can read one shuffle.
    x, y = used.alias("x"), used.alias("y")
    both = pairs.alias("p").join(x, F.col("p.s") == F.col("x.s")).join(y, F.col("p.t") == F.col("y.s"))
    return both.select(F.col("p.s").alias("s"), F.arrow_udf(_similar, "boolean")("x.set", "y.set").alias("same"))


def _similar(x: pa.Array, y: pa.Array) -> pa.Array:
    out = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x, y)):
        a, b = _unpacked(a.as_py()), _unpacked(b.as_py())
        both = np.sort(np.concatenate([a, b]))
        shared = int((both[1:] == both[:-1]).sum())
        out[k] = 5 * shared >= 4 * (len(a) + len(b) - shared)
    return pa.array(out)


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the array of lines that go (null where none) and the text that is left."""
    key, other, gone, left = common.fresh(docs, "key", "other_key", "gone", "left")
    marks = common.written(removals(docs).select(F.col("key").alias(other), F.col("lines").alias(gone)))
    joined = common.attach(docs.withColumn(key, common.row_key()), key, marks, other)
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    return joined.withColumn(left, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(key, other), gone, left


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, removed_lines, text) of every document."""
    done, gone, left = _cleaned(docs)
    return done.select("doc_id", F.coalesce(F.size(gone), F.lit(0)).alias("removed_lines"), F.when(F.col(left).rlike(r"[^\x00-\x20]"), F.col(left)).otherwise(F.when(F.col(gone).isNull(), F.col(left)).otherwise("")).alias("text"))


def keep_lines(docs: DataFrame) -> DataFrame:
    """The documents with the columns they came with, without repeated lines; those with nothing else left go."""
    done, gone, left = _cleaned(docs)
    done = done.filter(F.col(gone).isNull() | F.col(left).rlike(r"[^\x00-\x20]")).withColumn("text", F.col(left))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(common.table(spark, sf_dir, "documents"))


ORACLE = """
with l as (select doc_id, i, list_distinct(regexp_extract_all(lower(ls[i + 1]), '[^\\x00-\\x20]+')) as ws
           from (select doc_id, ls, unnest(range(0, len(ls))) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))),
p as (select list_sort(ws) as ws, len(ws) as n, min(doc_id * 1000000 + i) as head from l where len(ws) > 0 group by 1, 2),
t as (select head, n, unnest(ws) as w from p),
o as (select a.head as h, b.head as g, a.n as n, b.n as m, count(*) as c from t a join t b on a.w = b.w and a.head <> b.head and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by 1, 2, 3, 4),
s as (select h, min(g) as g from o where 5 * c >= 4 * (n + m - c) group by 1),
k as (select p.ws, least(p.head, coalesce(s.g, p.head)) as limit_ from p left join s on p.head = s.h),
d as (select l.doc_id, l.i, l.doc_id * 1000000 + l.i > k.limit_ as gone from l left join k on list_sort(l.ws) = k.ws),
r as (select doc_id, count(*) filter (where gone) as removed, string_agg(line, chr(10) order by i) filter (where gone is distinct from true) as left_
      from (select d.*, string_split(x.text, chr(10))[d.i + 1] as line from d join documents x using (doc_id)) group by doc_id)
select documents.doc_id, cast(coalesce(removed, 0) as integer) as removed_lines,
       case when coalesce(removed, 0) = 0 then text when regexp_matches(left_, '[^\\x00-\\x20]') then left_ else '' end as text
from documents left join r using (doc_id)
"""
