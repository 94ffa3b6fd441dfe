"""Exact removal of passages that repeat across documents, with suffix arrays.

A passage is ``WINDOW`` (50) consecutive words, words being what white space
separates. A passage is a repeat when an equal one starts earlier in the
corpus, documents being ordered by (doc_id nulls first, text hash): in
another document, or in the same one without overlapping it. Every word that
a repeat covers goes; the first occurrence stays.

**Bringing equal passages together.** Each passage is named by its anchor,
the least hash of the 16-word runs in it, so equal passages have equal
anchors wherever they stand. Consecutive passages of one anchor form a block.
All anchors are counted; a bitmap of those that occur in several blocks
leaves out the blocks that cannot repeat (it may let others through, never
drop one). The blocks left are sent, by anchor, to shards.

**Suffix arrays.** A shard collapses equal blocks and builds the suffix array
of the distinct ones by two-stage sorting: suffixes smaller than their
successors are sorted directly, all others are induced by one scan over the
buckets of their first words. Adjacent common prefixes of ``WINDOW`` words
then delimit the equal passages. Sorting compares ``WINDOW`` words: longer
prefixes cannot change which passages are equal.

**Hot anchors.** An anchor whose blocks have more than ``HOT_WORDS`` words
(boilerplate of very many documents) is never brought together: its passages
are named by 64-bit hashes, the first occurrence of each is a minimum that is
aggregated before it is shuffled, and the passages are joined with those.

Words are 48-bit hashes inside a shard, and a block's identity and the anchors
are 64-bit.

Defined results: null, empty and shorter texts have no passage and stay as
they are. Rows with equal id and text are one document listed more than once:
they keep the same words. Rows with equal id but other text are different
documents. Ids may be of any type that can be ordered. An empty table gives an empty result. Extra columns are kept by
``remove_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textarrays import SPACED, column, hashes, mix64, slices, words

WINDOW = 50
RUN = 16
#: Words of one suffix array; a single anchor's blocks are never split, and have HOT_WORDS words at most.
ARRAY_WORDS, HOT_WORDS = 400_000, 1 << 22
#: Words of a shard, about: a task holds one shard.
SHARD_WORDS = 1 << 24
_C = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the RUN words that start at each word (by doubling); the last RUN - 1 are left out."""
    size, out = 1, h
    while size < RUN:
        out = mix64(out[:-size] * _C + out[size:])
        size *= 2
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of passages with one anchor: (anchor, row, first word, number of passages); words count over all rows."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return np.zeros(0, np.uint64), none, none, none
    low = _sliding_min(_run_hashes(h), window - RUN + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(low)]
    valid = np.arange(len(low)) + window <= first[row + 1]
    new = valid & np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]
    at = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.r_[(low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~valid[1:], True]) + 1
    return low[at], row[at], at, stop - at


def _hashed(batch: pa.RecordBatch, name: str):
    """For slices of a batch: rows, word hashes and first words, short rows' words included."""
    buf, offs = column(batch.column(name))
    for lo, hi in slices(offs):
        b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = words(b, o, SPACED)
        yield lo, hashes(b, starts, ends), first


def _anchor_rows(it):
    """Anchors of a batch's blocks, their blocks' words, and whether one alone can repeat: it has two blocks, or passages that don't overlap."""
    for batch in it:
        got = [blocks(h, first)[::3] for _, h, first in _hashed(batch, "text")]
        a, n = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        o = np.argsort(a, kind="stable")
        a, n = a[o], n[o]
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        again = (np.diff(np.r_[at, len(a)]) > 1) | (np.maximum.reduceat(n, at) > WINDOW) if len(a) else np.zeros(0, bool)
        size = np.add.reduceat(n + WINDOW - 1, at) if len(a) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(size), pa.array(again)], ["anchor", "words", "again"])


def _passage_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit name of the WINDOW words that start at each word."""
    size, out = 1, h
    while size * 2 <= WINDOW:
        out = mix64(out[:-size] * _C + out[size:])
        size *= 2
    rest = WINDOW - size
    return mix64(out[: len(out) - rest] * _C + out[rest:]) if len(out) > rest else np.zeros(0, np.uint64)


#: Bytes of a word's hash in a block.
_WORD_BYTES = 6


def _packed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 8 - _WORD_BYTES :]


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - _WORD_BYTES :] = raw
    return out.view(np.uint64)[:, 0]


_BLOCK = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("heads", pa.binary()), ("words", pa.binary())])
#: anchor, document order rank is by (known, doc_id, key); start word; passages; words
_HEAD = np.dtype([("anchor", "u8"), ("known", "u1"), ("doc", "i8"), ("key", "i8"), ("start", "u4"), ("passages", "u4"), ("size", "u4")])


def sort_suffixes(t: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Suffix array of ``t`` (ranks >= 1, with 0 behind every block) by two-stage sorting.

    Order is decided by the first ``window`` values at least. The zeros' own
    suffixes come first, in order of position.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    following = np.r_[t[1:], 0]
    # A suffix is small when it is less than its successor; equal neighbours take the next one's kind.
    kind = np.sign(following - t)
    at = np.flatnonzero(kind)
    nearest = np.searchsorted(at, np.arange(n))
    small = np.where(nearest < len(at), kind[at[np.minimum(nearest, len(at) - 1)]] > 0, False) if len(at) else np.zeros(n, bool)
    small &= t > 0
    zeros = np.flatnonzero(t == 0)
    direct = np.flatnonzero(small)
    # First stage: big-endian bytes compare as the values do; a key ends behind its block.
    raw = np.r_[t, np.zeros(window, t.dtype)].astype(">u4").tobytes()
    ends = np.r_[zeros, n]
    stop = np.minimum(direct + window, ends[np.searchsorted(ends, direct)] + 1)
    keys = [raw[4 * a : 4 * b] for a, b in zip(direct.tolist(), stop.tolist())]
    order = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    del keys
    # Second stage: buckets by first value hold large suffixes in front, small ones behind.
    counts = np.bincount(t)
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    sa = np.full(n, -1, np.int64)
    sa[: len(zeros)] = zeros
    if len(order):
        first = t[order]
        smalls = np.bincount(first, minlength=len(counts))
        behind = begin + counts - smalls
        rank = np.arange(len(order)) - np.r_[0, np.cumsum(smalls)[:-1]][first]
        sa[behind[first] + rank] = order
    _induce(t, np.flatnonzero(~small & (t > 0)), sa, begin, np.cumsum(counts))
    return sa


#: Buckets are scanned in groups of at least so many suffixes.
_SCAN = 1 << 14


def _induce(t: np.ndarray, large: np.ndarray, sa: np.ndarray, begin: np.ndarray, upto: np.ndarray) -> None:
    """Fill the fronts of the buckets of ``sa`` with the large suffixes, group of buckets by group of buckets.

    A large suffix stands in its bucket as the suffix behind its run of equal
    words stands among all, after those of shorter runs. That one is in a lower
    bucket: in an earlier group, or in the same group, which is then scanned
    until no new suffix is induced.
    """
    if not len(large):
        return
    n = len(t)
    breaks = np.r_[np.flatnonzero(t[1:] != t[:-1]) + 1, n]
    behind = breaks[np.searchsorted(breaks, large, "right")]
    run = np.minimum(behind - large, WINDOW)
    place = np.full(n + 1, -1, np.int64)
    there = np.flatnonzero(sa >= 0)
    place[sa[there]] = there
    place[n] = -2  # nothing: before all
    o = np.argsort(t[large], kind="stable")
    large, behind, run = large[o], behind[o], run[o]
    value = t[large]
    lo = 0
    while lo < len(large):
        hi = int(np.searchsorted(value, value[min(lo + _SCAN, len(large)) - 1], "right"))
        p, q, c, m = large[lo:hi], behind[lo:hi], value[lo:hi], run[lo:hi]
        lo, known = hi, 0
        while True:
            on = np.flatnonzero(place[q] != -1)
            if len(on) == known:
                break
            known = len(on)
            # Positions are those among the suffixes known so far: their order is final.
            by = on[np.lexsort((place[q[on]], m[on], c[on]))]
            first = np.r_[0, np.flatnonzero(c[by][1:] != c[by][:-1]) + 1]
            rank = np.arange(known) - np.repeat(first, np.diff(np.r_[first, known]))
            place[p[by]] = begin[c[by]] + rank
        sa[place[p]] = p


def common_prefixes(t: np.ndarray, sa: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Common prefix of each suffix and the one before it in ``sa``, up to ``window``; it ends at a 0.

    It is composed of runs of 2**k words, longest first, compared by 64-bit
    hashes; those that hold a 0 are like no other.
    """
    n = len(t)
    levels = [np.where(t > 0, mix64(t.astype(np.uint64)), mix64(np.arange(n).astype(np.uint64) + _C))]
    while 2 ** len(levels) <= window:
        size, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(mix64(last[: max(0, len(last) - size)] * _C + last[size:]))
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        run, size = levels[k], 2**k
        a, b = sa[:-1] + lcp[1:], sa[1:] + lcp[1:]
        at = np.flatnonzero((np.maximum(a, b) < len(run)) & (lcp[1:] + size <= window))
        lcp[1 + at[run[a[at]] == run[b[at]]]] += size
    return lcp


def _collapse(heads: np.ndarray, text: np.ndarray, offs: np.ndarray):
    """Block of each head, and one head of each distinct block. Equal blocks have equal anchor, size and words."""
    size = heads["size"].astype(np.int64)
    mixed = mix64(text.astype(np.uint64) + _C * (np.arange(len(text)) - np.repeat(offs[:-1], size)).astype(np.uint64))
    total = np.add.reduceat(mixed, offs[:-1]) + mix64(heads["anchor"] + size.astype(np.uint64))
    _, one, same = np.unique(total, return_index=True, return_inverse=True)
    return same, one


def repeats(heads: np.ndarray, text: np.ndarray, window: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
    """Repeated passages of blocks with few anchors: (head index, first word, passages, index of the first occurrence's head).

    ``heads`` are sorted by anchor; ``text`` has the blocks' words in the same order.
    """
    offs = np.r_[0, np.cumsum(heads["size"].astype(np.int64))]
    same, one = _collapse(heads, text, offs)
    # Distinct blocks' words, a 0 behind each.
    size = heads["size"][one].astype(np.int64)
    start = np.r_[0, np.cumsum(size + 1)]
    src = np.repeat(offs[one] - start[:-1], size) + _spread(start[:-1], size)
    t = np.zeros(start[-1], np.int64)
    ranks = np.unique(text[src], return_inverse=True)[1] + 1
    t[_spread(start[:-1], size)] = ranks
    sa = sort_suffixes(t, window)
    lcp = common_prefixes(t, sa, window)
    group = np.empty(len(t), np.int64)
    group[sa] = np.cumsum(lcp < window)
    # One entry for each passage of each head: its class, in corpus order.
    n = heads["passages"].astype(np.int64)
    head = np.repeat(np.arange(len(heads)), n)
    inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    cls = group[start[:-1][same[head]] + inner]
    word = heads["start"][head].astype(np.int64) + inner
    order_of = np.empty(len(heads), np.int64)
    by = np.lexsort((heads["start"], heads["key"], heads["doc"], heads["known"]))
    order_of[by] = np.arange(len(heads))
    o = np.lexsort((word, order_of[head], cls))
    head, word, cls = head[o], word[o], cls[o]
    lead = np.r_[True, cls[1:] != cls[:-1]]
    at = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    fh, fw = head[at], word[at]
    same_doc = (heads["key"][head] == heads["key"][fh]) & (heads["doc"][head] == heads["doc"][fh]) & (heads["known"][head] == heads["known"][fh])
    # A repeated row gives equal (document, word) twice: neither is a repeat of the other.
    return head, word, fh, ~lead & (~same_doc | (word >= fw + window))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size)


_SPAN = pa.schema([("known", pa.bool_()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("from_doc", pa.int64())])
_SPAN_DDL = "known boolean, doc long, key long, start int, end int, from_doc long"


def _find(it):
    """Spans that repeat, from a shard's block rows."""
    heads, texts = [], []
    for batch in it:
        for hb, wb in zip(batch.column("heads"), batch.column("words")):
            heads.append(np.frombuffer(hb.as_py(), _HEAD))
            texts.append(np.frombuffer(wb.as_py(), np.uint8).reshape(-1, _WORD_BYTES))
    if not heads:
        return
    h = np.concatenate(heads)
    text = np.concatenate(texts)  # widened only by the array at hand
    del heads, texts
    offs = np.r_[0, np.cumsum(h["size"].astype(np.int64))]
    by = np.argsort(h["anchor"], kind="stable")
    h, offs_by = h[by], offs[:-1][by]
    edge = np.r_[np.flatnonzero(np.r_[True, h["anchor"][1:] != h["anchor"][:-1]]), len(h)]
    upto = np.r_[0, np.cumsum(h["size"].astype(np.int64))]
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(upto[edge], upto[edge[lo]] + ARRAY_WORDS, "right")) - 1)
        a, b = edge[lo], edge[hi]
        part = h[a:b]
        words_ = _unpacked(text[_spread(offs_by[a:b], part["size"].astype(np.int64))])
        head, word, source, gone = repeats(part, words_)
        lo = hi
        if not gone.any():
            continue
        head, word, source = head[gone], word[gone], source[gone]
        # Adjacent passages of one head with one source document become one span.
        o = np.lexsort((word, head))
        head, word, source = head[o], word[o], source[o]
        sdoc = part["key"][source]
        new = np.r_[True, (head[1:] != head[:-1]) | (word[1:] != word[:-1] + 1) | (sdoc[1:] != sdoc[:-1])]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(head)] - 1
        known = part["known"][source[s]] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(part["known"][head[s]] > 0), pa.array(part["doc"][head[s]]), pa.array(part["key"][head[s]]), pa.array(word[s].astype(np.int32)), pa.array((word[e] + WINDOW).astype(np.int32)), pa.array(part["doc"][source[s]], mask=~known)],
            schema=_SPAN,
        )


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, key, text) of the documents with text, ``doc`` a number of the ids' order, and the ids (id, number), None where they are numbers."""
    names, keyed = common.id_numbers(docs, "doc_id"), docs.select("doc_id", common.row_key().alias("key"), "text").filter("text is not null")
    if names is not None:
        keyed = keyed.join(names.toDF("doc_id", "number"), "doc_id", "left").select(F.col("number").alias("doc_id"), "key", "text")
    return keyed.select(F.col("doc_id").cast("long").alias("doc"), "key", "text"), names


def spans(keyed: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(known, doc, key, start, end, from_doc): words [start, end) of a document, of which passages of ``from_doc`` cover each; they may overlap."""
    spark = common.tune(keyed.sparkSession)
    anchors = keyed.select("text").mapInArrow(common.lean(_anchor_rows), "anchor long, words long, again boolean")
    counted = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.sum("words").alias("words"))
    several = common.written(counted.filter("n > 1 or again").select("anchor", "words"))
    size = several.agg(F.count("*"), F.sum("words"), F.count(F.when(F.col("words") > hot_words, 1))).first()
    known = spark.sparkContext.broadcast(common.bitmap(several, "anchor", size[0]))
    hot = spark.sparkContext.broadcast(common.bitmap(several.filter(F.col("words") > hot_words), "anchor", size[2]) if size[2] else None)
    shards = max(12, 4 * common.parts(spark), (size[1] or 0) // SHARD_WORDS)
    found = _in_shards(keyed, known, hot, shards)
    return found.union(_hot_spans(keyed, hot)) if size[2] else found


def _hot_spans(keyed: DataFrame, hot) -> DataFrame:
    """Spans of the passages of hot anchors, by their hashes."""

    def emit(it):
        for batch in it:
            doc, key = batch.column("doc"), batch.column("key")
            for lo, h, first in _hashed(batch, "text"):
                anchor, row, at, n = blocks(h, first)
                ok = common.in_bitmap(hot.value, anchor)
                if not ok.any():
                    continue
                row, at, n = row[ok], at[ok], n[ok]
                word, of = _spread(at, n), np.repeat(row, n)
                take = pa.array(lo + of)
                own = doc.take(take)
                yield pa.RecordBatch.from_arrays([pa.array(_passage_hashes(h)[word].view(np.int64)), own.is_valid(), own.fill_null(0), key.take(take), pa.array((word - first[of]).astype(np.int32))], ["p", "known", "doc", "key", "word"])

    each = keyed.mapInArrow(common.lean(emit), "p long, known boolean, doc long, key long, word int")
    place = F.struct("known", "doc", "key", "word")
    firsts = each.groupBy("p").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l")
    firsts = common.written(firsts.select("p", "f"))
    here, there = F.struct("known", "doc", "key"), F.struct("f.known", "f.doc", "f.key")
    again = each.join(common.side(firsts), "p").filter((here != there) | (F.col("word") >= F.col("f.word") + WINDOW))
    rows = again.select("known", "doc", "key", "word", F.col("f.key").alias("source"), F.when(F.col("f.known"), F.col("f.doc")).alias("from_doc"))
    return rows.mapInArrow(_merged, _SPAN_DDL)


def _merged(it):
    """Passages that follow one another, and have one source, as one span."""
    for batch in it:
        if not batch.num_rows:
            continue
        key, word, source = (batch.column(c).to_numpy() for c in ("key", "word", "source"))
        new = np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1] + 1) | (source[1:] != source[:-1])]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(key)] - 1
        take = pa.array(s)
        yield pa.RecordBatch.from_arrays([batch.column("known").take(take), batch.column("doc").take(take), batch.column("key").take(take), pa.array(word[s]), pa.array((word[e] + WINDOW).astype(np.int32)), batch.column("from_doc").take(take)], schema=_SPAN)


def _in_shards(keyed: DataFrame, known, hot, shards: int) -> DataFrame:
    """Spans of the passages of all other anchors, by suffix arrays."""

    def send(it):
        for batch in it:
            doc, key = batch.column("doc"), batch.column("key").to_numpy()
            ids, have = doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False)
            for lo, h, first in _hashed(batch, "text"):
                anchor, row, at, n = blocks(h, first)
                ok = common.in_bitmap(known.value, anchor)
                if hot.value is not None:
                    ok &= ~common.in_bitmap(hot.value, anchor)
                if not ok.any():
                    continue
                anchor, row, at, n = anchor[ok], row[ok], at[ok], n[ok]
                shard = (mix64(anchor) % np.uint64(shards)).astype(np.int32)
                o = np.argsort(shard, kind="stable")
                anchor, row, at, n, shard = anchor[o], row[o], at[o], n[o], shard[o]
                size = n + WINDOW - 1
                heads = np.empty(len(o), _HEAD)
                heads["anchor"], heads["known"], heads["doc"], heads["key"] = anchor, have[lo + row], ids[lo + row], key[lo + row]
                heads["start"], heads["passages"], heads["size"] = at - first[row], n, size
                flat = _packed(h[_spread(at, size)])
                cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(o)]
                upto = np.r_[0, np.cumsum(size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array([heads[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([flat[upto[a] : upto[b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    schema=_BLOCK,
                )

    sent = keyed.mapInArrow(common.lean(send), "shard int, n int, heads binary, words binary")
    return sent.repartition(shards, "shard").mapInArrow(common.lean(_find), _SPAN_DDL)


def union_spans(found: DataFrame) -> DataFrame:
    """(known, doc, key, start, end, from_docs): the union of each document's spans as disjoint intervals."""
    doc = Window.partitionBy("known", "doc", "key").orderBy("start")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = opened.withColumn("span", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("known", "doc", "key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("from_doc")).alias("from_docs"))


def passages(docs: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_ids): words that go, and the documents that had them first."""
    keyed, names = _keyed(docs)
    each = union_spans(spans(keyed, hot_words))
    each = each.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("from_docs").alias("first_doc_ids"), "key")
    if names is None:
        return each.drop("key")
    left, right = names.toDF("id", "doc_id"), names.toDF("from_id", "number")
    sources = each.select("key", "start_word", F.explode("first_doc_ids").alias("number")).join(right, "number").groupBy("key", "start_word").agg(F.sort_array(F.collect_set("from_id")).alias("ids"))
    named = each.join(left, "doc_id", "left").join(sources, ["key", "start_word"], "left")
    return named.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.coalesce("ids", F.array().cast(sources.schema["ids"].dataType)).alias("first_doc_ids"))


def _cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
    """Texts without the words of their spans; each cut ends where the next kept word starts."""
    out = []
    for text, cuts in zip(texts, spans_):
        if not cuts.is_valid or not text.is_valid:
            out.append(text.as_py())
            continue
        raw = np.frombuffer(text.as_py().encode(), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]), SPACED)
        keep, last = [], 0
        for c in cuts.as_py():
            keep.append(raw[last : starts[c["start"]]].tobytes())
            last = starts[c["end"]] if c["end"] < len(starts) else len(raw)
        keep.append(raw[last:].tobytes())
        out.append(b"".join(keep).decode("utf-8", "replace"))
    common.trim()
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """The documents, with the columns they came with, without repeated passages. Documents with nothing else left go."""
    key, other, spans_ = common.fresh(docs, "key", "cut_key", "cut_spans")
    cuts = union_spans(spans(_keyed(docs)[0], hot_words)).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    cuts = common.written(cuts.select(F.col("key").alias(other), F.col("s").alias(spans_)))
    joined = common.attach(docs.withColumn(key, common.row_key()), key, cuts, other)
    # Only texts with a span go through Python, and once: a filter on a deterministic function would call it again, in further workers.
    left = F.arrow_udf(_cut, "string").asNondeterministic()(F.when(F.col(spans_).isNotNull(), F.col("text")), F.col(spans_))
    done = joined.withColumn(other, left).filter(F.col(spans_).isNull() | F.col(other).rlike(r"[^\x00-\x20]"))
    done = done.withColumn("text", F.coalesce(F.col(other), F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(other).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.table(spark, sf_dir, "documents"))


ORACLE = """
with w as (select doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') as ws from documents),
p as (select doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') as t
      from (select doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0))) as i from w)),
h as (select doc_id, i, md5(t) as t from p),
f as (select doc_id, i, first_value(doc_id) over g as fd, first_value(i) over g as fi from h window g as (partition by t order by doc_id, i)),
r as (select doc_id, i, fd from f where doc_id <> fd or i >= fi + 50),
m as (select *, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from r),
g as (select *, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as span from m)
select doc_id, cast(min(i) as integer) as start_word, cast(max(i) + 50 as integer) as end_word,
       list_sort(list_distinct(list(fd))) as first_doc_ids
from g group by doc_id, span
"""
