"""Near-duplicate documents: SimHash fingerprints searched with vantage-point trees.

**Fingerprint.** 192 bits over the distinct lower-case words of the whole
text: bit b is set when more than half of the words' hashes have it set. Two
documents are near copies when their fingerprints differ in at most
``RADIUS`` bits.

**Exact search.** The fingerprint is 12 segments of 16 bits. Two fingerprints
at most 35 bits apart agree to within 2 bits in some segment (12 * 3 > 35), so
searching every segment for values at Hamming distance <= 2 misses no pair.
Each segment's values are searched with vantage-point trees: a node halves
its values at the median distance ``m`` from a vantage value; a query at
distance ``d`` needs the near side only if d - 2 <= m and the far side only if
d + 2 > m (the triangle bounds). The upper levels of the trees, grown until a
cell holds about ``CELL_ROWS`` fingerprints, cut each segment into shards; a
fingerprint lives in one shard of a segment and is sent as a query to all
shards that its ball overlaps. A cell that holds several times as many (its
load is counted) is cut further, by hash, and queried in all its parts. A
shard grows the lower levels itself. Pairs that a segment finds are verified
on all 192 bits. (Trees over whole fingerprints would prune nothing: the
distances of unrelated fingerprints differ by less than the radius.)

Only distinct fingerprints are searched, so groups of thousands of copies
cost one fingerprint. No link is lost, and none is listed: a shard counts the
links of its fingerprints, each pair in the first segment that finds it, and
gives as many pairs as connect what its pairs connect. However many
fingerprints share a value, a bounded number of pairs is held at once. Where
only classes are asked for (``keep_first``), pairs that are connected already
are passed over, so a group of near copies costs about its size, not its
square; counting links looks at every pair. Classes are the connected
components, and the document that is first by (doc_id nulls first,
then text hash) stays.

Defined results: null or blank text has no fingerprint, is never a near copy
and is a class of its own. Text without letters or digits is a copy only of
equal text. Rows with equal id and text are one document listed twice: they
get equal results, and ``keep_first`` keeps the first of them in the order of
their other columns (those with null text all stay). Rows with equal id but
different text are different documents. A class is named by its least id that
is not null. An empty table gives an empty result. Extra columns are kept by
``keep_first`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textarrays import ALNUM, column, hashes, mix64, slices, words

BITS, SEGMENTS, SEGMENT_BITS = 192, 12, 16
RADIUS = 35
NEAR = RADIUS // SEGMENTS
#: 12 segments are 6 siblings in twos: 6 * 6 > 35.
PAIR_NEAR = RADIUS // (SEGMENTS // 2)
CELL_ROWS = 1 << 20
_ASKS = 1 << 18
_LEAF = 48
_VOTES = 100_000
#: Pairs that a shard looks at at once; rows of a tile of two values that more have; pairs after which values of one class are left out.
_AT_ONCE, _TILE, _RENEW = 1 << 18, 1 << 9, 1 << 23


def _vote(h: np.ndarray) -> np.ndarray:
    """How many of the words have each bit."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _VOTES):
        part = h[i : i + _VOTES]
        three = np.stack([part, mix64(part + np.uint64(0x9E3779B97F4A7C15)), mix64(part + np.uint64(0x3C6EF372FE94F82A))], axis=1)
        bits = np.unpackbits(three.view(np.uint8), axis=1)
        # uint8 sums of up to 255 rows stay within the narrow type
        whole = len(bits) // 255 * 255
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return total


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) uint64 fingerprints and which rows have one."""
    buf, offs = column(texts)
    out, has = np.zeros((len(offs) - 1, 3), np.uint64), np.zeros(len(offs) - 1, bool)
    for lo, hi in slices(offs):
        b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = words(b, o, ALNUM)
        key = hashes(b, starts, ends)
        for r in range(hi - lo):
            h = key[first[r] : first[r + 1]]
            if len(h):
                h = np.sort(h)
                h = h[np.r_[True, h[1:] != h[:-1]]]
                bits = _vote(h) * 2 > len(h)
                out[lo + r], has[lo + r] = np.packbits(bits).view(np.uint64), True
            elif raw := b[o[r] : o[r + 1]].tobytes().strip():
                out[lo + r], has[lo + r] = np.frombuffer(hashlib.blake2b(raw, digest_size=24).digest(), np.uint64), True
    return out, has


def _fingerprint(texts: pa.Array) -> pa.Array:
    got, has = fingerprints(texts)
    common.trim()
    return pa.array([got[i].tobytes() if has[i] else None for i in range(len(has))], pa.binary())


def fingerprint(text):
    """Column of 24-byte fingerprints, computed once (a filter on a deterministic one would compute it again, in further Python workers)."""
    return F.arrow_udf(_fingerprint, "binary").asNondeterministic()(F.lower(text))


def _matrix(col) -> np.ndarray:
    """(n, 3) uint64 of an Arrow column of 24-byte values."""
    buf, _ = column(col)
    return np.frombuffer(buf.tobytes(), np.uint64).reshape(-1, 3)


def segments(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps).view(np.uint16).reshape(len(fps), SEGMENTS)


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def plant(values: np.ndarray, depth: int) -> tuple:
    """Upper levels of a vantage-point tree over 16-bit values: (vantage, median, near, far) or a cell's number."""
    cells = 0

    def grow(own: np.ndarray, left: int):
        nonlocal cells
        if left == 0 or len(own) < 2:
            cells += 1
            return cells - 1
        vantage = own[len(own) // 2]
        d = _far(own, vantage)
        m = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        near = d <= m
        if near.all():
            cells += 1
            return cells - 1
        return int(vantage), m, grow(own[near], left - 1), grow(own[~near], left - 1)

    return grow(values, depth), cells


def route(tree, values: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of value, cell) for each cell that the ball of radius ``slack`` about a value overlaps."""
    rows, cells = [], []

    def walk(node, at: np.ndarray):
        if not len(at):
            return
        if not isinstance(node, tuple):
            rows.append(at)
            cells.append(np.full(len(at), node, np.int64))
            return
        vantage, m, near, far = node
        d = _far(values[at], np.uint16(vantage)).astype(np.int64)
        walk(near, at[d - slack <= m])
        walk(far, at[d + slack > m])

    walk(tree, np.arange(len(values)))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_values(points: np.ndarray, queries: np.ndarray, slack: int = NEAR):
    """Chunks of all (index of point, index of query) at distance <= slack, by a vantage-point tree over the points."""
    stack, left, right, held = [(np.arange(len(points), dtype=np.int32), np.arange(len(queries), dtype=np.int32))], [], [], 0
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) > _LEAF:
            vantage = points[own[len(own) // 2]]
            d = _far(points[own], vantage).astype(np.int8)
            m = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            near = d <= m
            if not near.all():
                q = _far(queries[asked], vantage).astype(np.int8)
                stack.append((own[near], asked[q - slack <= m]))
                stack.append((own[~near], asked[q + slack > m]))
                continue
        for k in range(0, len(asked), 1 << 14):
            some = asked[k : k + (1 << 14)]
            i, j = np.nonzero(_far(points[own][:, None], queries[some][None, :]) <= slack)
            left.append(own[i])
            right.append(some[j])
            held += len(i)
            if held > 1 << 17:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _of_one(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The label that all rows from each of ``at`` to the next have; -1 where they differ."""
    low = np.minimum.reduceat(label, at)
    return np.where(low == np.maximum.reduceat(label, at), low, -1)


def _tiles(h: np.ndarray, q: np.ndarray, hs: np.ndarray, qs: np.ndarray, spare: int, classes):
    """Chunks of (home, ask) indexes of ``h`` and ``q`` within ``spare`` in the sibling segment, tile by tile."""
    for x in range(0, len(h), _TILE):
        own, rest = h[x : x + _TILE], q
        while len(rest):
            if classes:
                home, asked = classes(own, rest)
                if (home == home[0]).all():
                    rest = rest[asked != home[0]]
            some, rest = rest[:_TILE], rest[_TILE:]
            i, j = np.nonzero(_far(hs[own][:, None], qs[some][None, :]) <= spare)
            if len(i):
                yield own[i], some[j]


def _shard_pairs(home: np.ndarray, asks: np.ndarray, segment: int, classes=None):
    """Chunks of (home, ask) indexes that agree to within NEAR bits in the segment and within PAIR_NEAR in it and its sibling.

    Segments are siblings in twos: of two fingerprints at most RADIUS apart,
    some two siblings together differ in at most PAIR_NEAR bits, and one of
    them in at most half of that. ``home`` and ``asks`` come sorted by the
    segment's value; only home values not above the ask's are given, as the
    pair meets again in the other one's shard. However many rows have a value,
    a chunk has ``_AT_ONCE`` pairs at most. ``classes(i, j)`` gives the classes
    that home and ask rows are known to be in by then (-1: none); with it,
    pairs of one class may be left out.
    """
    hv, qv = np.ascontiguousarray(home[:, segment]), np.ascontiguousarray(asks[:, segment])
    hs, qs = np.ascontiguousarray(home[:, segment ^ 1]), np.ascontiguousarray(asks[:, segment ^ 1])
    hu, hat, hc = np.unique(hv, return_index=True, return_counts=True)
    qu, qat, qc = np.unique(qv, return_index=True, return_counts=True)
    hat, qat = hat.astype(np.int32), qat.astype(np.int32)
    for p, q in near_values(hu, qu):
        ok = hu[p] <= qu[q]
        p, q = p[ok], q[ok]
        while len(p):
            if classes:
                known, asked = classes(slice(None), slice(None))
                known, asked = _of_one(known, hat), _of_one(asked, qat)
                ok = (known[p] < 0) | (known[p] != asked[q])
                p, q = p[ok], q[ok]
            spare = (PAIR_NEAR - _far(hu[p], qu[q])).astype(np.uint8)
            ends = np.cumsum(hc[p] * qc[q])
            lo = 0
            while lo < len(p) and not (classes and lo and ends[lo - 1] > _RENEW):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _AT_ONCE, "right")))
                pp, qq = p[lo:hi], q[lo:hi]
                if hi == lo + 1 and hc[pp[0]] * qc[qq[0]] > _AT_ONCE:
                    h, a = (np.arange(at, at + n, dtype=np.int32) for at, n in ((hat[pp[0]], hc[pp[0]]), (qat[qq[0]], qc[qq[0]])))
                    yield from _tiles(h, a, hs, qs, int(spare[lo]), classes)
                    lo = hi
                    continue
                n = hc[pp]
                i = np.repeat(hat[pp] - np.r_[0, np.cumsum(n)[:-1]].astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
                which = np.repeat(np.arange(len(pp), dtype=np.int32), n)
                n = qc[qq][which]
                j = np.repeat(qat[qq][which] - np.r_[0, np.cumsum(n)[:-1]].astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
                i, left = np.repeat(i, n), np.repeat(spare[lo:hi][which], n)
                ok = np.flatnonzero(_far(hs[i], qs[j]) <= left)
                if len(ok):
                    yield i[ok], j[ok]
                lo = hi
            p, q = p[lo:], q[lo:]


def _verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the index pairs that are at most RADIUS apart on all bits, with their distances."""
    d = np.zeros(len(i), np.int64)
    for w in range(3):
        d = d + np.bitwise_count(a[i, w] ^ b[j, w])
        ok = d <= RADIUS
        i, j, d = i[ok], j[ok], d[ok]
    return i, j, d


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components of ``label`` (each node's least member so far) along the pairs."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            deep = label[label]
            if (deep == label).all():
                break
            label = deep


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32()), ("links", pa.int64())])
_FOUND_DDL = "a long, b long, distance int, links long"
_SENT = pa.schema([("shard", pa.int32()), ("asks", pa.bool_()), ("fid", pa.int64()), ("fp", pa.binary()), ("docs", pa.int64())])
_SENT_DDL = "shard int, asks boolean, fid long, fp binary, docs long"


def _first_found(home: np.ndarray, asks: np.ndarray, segment: int) -> np.ndarray:
    """Whether no segment before this one finds the pairs (rows of two equally long tables of segments)."""
    d = _far(home, asks)
    found = (d <= NEAR) & (d + d[:, np.arange(SEGMENTS) ^ 1] <= PAIR_NEAR)
    return ~found[:, :segment].any(1)


class _Shard:
    """A shard's home fingerprints and what is found of them; queries are streamed past."""

    def __init__(self, home: pa.Table, segment: int, forest: bool, counts: bool):
        fid, fps = home["fid"].to_numpy(), _matrix(home["fp"])
        o = np.argsort(segments(fps)[:, segment], kind="stable")
        self.fid, self.fps, self.docs = fid[o], fps[o], home["docs"].to_numpy()[o]
        self.segment, self.forest, self.counts = segment, forest, counts
        self.links, self.label = np.zeros(len(o), np.int64), np.arange(len(o))
        self.by_fid = None if counts else np.argsort(self.fid)

    def ask(self, asks: pa.Table):
        """Rows of what is found: pairs, or the queries' counts of links."""
        fid, fps, docs = asks["fid"].to_numpy(), _matrix(asks["fp"]), asks["docs"].to_numpy()
        o = np.argsort(segments(fps)[:, self.segment], kind="stable")
        fid, fps, docs = fid[o], fps[o], docs[o]
        hseg, qseg = segments(self.fps), segments(fps)
        links, done = np.zeros(len(fid), np.int64), np.full(len(fid), -1, np.int64)
        if not self.counts:
            # A query that is at home here is its own first partner, so that its class is known.
            at = self.by_fid[np.minimum(np.searchsorted(self.fid, fid, sorter=self.by_fid), len(self.fid) - 1)]
            done = np.where(self.fid[at] == fid, at, -1)

        def classes(i, j):
            return self.label[i], np.where(done[j] < 0, -1, self.label[done[j]])

        for i, j in _shard_pairs(hseg, qseg, self.segment, None if self.counts else classes):
            i, j = i.astype(np.int64), j.astype(np.int64)
            # Of fingerprints with one value each is home and query to the other: once is enough.
            ok = (self.fid[i] < fid[j]) | ((hseg[i, self.segment] != qseg[j, self.segment]) & (self.fid[i] != fid[j]))
            i, j, d = _verified(self.fps, fps, i[ok], j[ok])
            if self.counts:
                ok = _first_found(hseg[i], qseg[j], self.segment)
                i, j, d = i[ok], j[ok], d[ok]
            if not len(i):
                continue
            if self.counts and self.forest:
                self.links += np.bincount(i, docs[j], len(self.links)).astype(np.int64)
                links += np.bincount(j, self.docs[i], len(links)).astype(np.int64)
            if self.forest:
                # The first partner of each query is its link; others are merged with that one.
                fresh = np.flatnonzero(done[j] < 0)
                _, one = np.unique(j[fresh], return_index=True)
                fresh = fresh[one]
                done[j[fresh]] = i[fresh]
                self.label = _join(self.label, i, done[j])
                i, j, d = i[fresh], j[fresh], d[fresh]
            yield self._pairs(self.fid[i], fid[j], d)
        yield self._counts(fid, links)

    def close(self):
        """The pairs that connect the home fingerprints, and their counts of links."""
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        yield self._pairs(self.fid[i], self.fid[self.label[i]], None)
        yield self._counts(self.fid, self.links)

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(n, pa.int32()) if d is None else pa.array(d, pa.int32()), pa.nulls(n, pa.int64())], schema=_FOUND)

    @staticmethod
    def _counts(fid: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        n = len(some)
        return pa.RecordBatch.from_arrays([pa.array(fid[some]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(links[some])], schema=_FOUND)


def _search(prints: DataFrame, rows: int, cell_rows: int, forest: bool, counts: bool = True) -> DataFrame:
    """(a, b, distance, links): pairs a < b of the distinct fingerprints ``prints`` (fid, fp, docs), each once; with ``forest`` only
    as many as connect what they connect, and rows with null b that add up to the number of documents that ``a`` is linked to. Without
    ``counts`` a forest has no such rows, pairs that are connected already are not looked at, and some come from several segments."""
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / cell_rows))))
    every = np.random.default_rng(7).permutation(1 << SEGMENT_BITS).astype(np.uint16)
    # A tree over all 2**16 values needs no look at the data and serves every segment.
    tree, cells = plant(every, depth)

    def load(it):
        total = np.zeros(SEGMENTS * cells, np.int64)
        for batch in it:
            seg = segments(_matrix(batch.column(0)))
            for s in range(SEGMENTS):
                total += np.bincount(s * cells + route(tree, seg[:, s], 0)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    loads = np.zeros(SEGMENTS * cells, np.int64)
    for r in prints.select("fp").mapInArrow(load, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        loads[r["cell"]] = r["n"]
    many = np.maximum(1, -(-loads // (4 * cell_rows)))
    first = np.r_[0, np.cumsum(many)]
    cell_of = np.repeat(np.arange(len(many)), many)

    def send(batch: pa.RecordBatch):
        fid, fps, docs = (batch.column(c) for c in ("fid", "fp", "docs"))
        seg, mixed = segments(_matrix(fps)), mix64(fid.to_numpy().astype(np.uint64))
        for s in range(SEGMENTS):
            row, cell = route(tree, seg[:, s], 0)
            cell = s * cells + cell
            take = pa.array(row)
            yield {"shard": first[cell] + (mixed[row] % many[cell].astype(np.uint64)).astype(np.int64), "asks": np.zeros(len(row), bool), "fid": fid.take(take), "fp": fps.take(take), "docs": docs.take(take)}
            row, cell = route(tree, seg[:, s], NEAR)
            cell = s * cells + cell
            part = np.arange(many[cell].sum()) - np.repeat(np.cumsum(many[cell]) - many[cell], many[cell])
            take = pa.array(np.repeat(row, many[cell]))
            yield {"shard": np.repeat(first[cell], many[cell]) + part, "asks": np.ones(len(part), bool), "fid": fid.take(take), "fp": fps.take(take), "docs": docs.take(take)}

    def find(it):
        own, number, held, size = None, -1, [], 0
        for shard, home, asks in common.met(it):
            if held and (home is not None or size >= _ASKS):
                yield from own.ask(pa.Table.from_batches(held))
                held, size = [], 0
            if home is not None:
                if own and forest:
                    yield from own.close()
                own, number = _Shard(home, int(cell_of[shard]) // cells, forest, counts), shard
            else:
                held.append(asks)
                size += asks.num_rows
        if held:
            yield from own.ask(pa.Table.from_batches(held))
        if own and forest:
            yield from own.close()

    sent = prints.select("fid", "fp", "docs").mapInArrow(common.batches(send, _SENT), _SENT_DDL)
    return common.placed(sent, "shard", int(first[-1]), F.col("asks")).mapInArrow(common.lean(find), _FOUND_DDL)


def pairs(prints: DataFrame, rows: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact pairs (a, b, distance), a < b, of distinct fingerprints ``prints`` (fid, fp); ``rows`` is their number."""
    return _search(prints.withColumn("docs", F.lit(1).cast("long")), rows, cell_rows, False).filter("b is not null").drop("links")


def _prints(docs: DataFrame) -> DataFrame:
    """(key, doc_id, fp) of every document with text; fp is null where that is blank."""
    return docs.filter(F.col("text").isNotNull()).select("doc_id", common.row_key().alias("key"), fingerprint(F.col("text")).alias("fp"))


def _classes(prints: DataFrame, cell_rows: int, counts: bool = True) -> DataFrame:
    """(fp, root, links) of the fingerprints of ``prints`` (key, doc_id, fp) that several documents have or that are near others.

    Fingerprints that one document has two of are of one class. ``links``
    counts the documents at most RADIUS away, the document itself left out;
    it is there with ``counts`` only.
    """
    each = prints.filter("fp is not null").select("fp", "key").distinct()
    heads = common.written(each.groupBy("fp").agg(F.count("*").alias("docs")).select(F.xxhash64("fp").alias("fid"), "fp", "docs"))
    found = common.written(_search(heads.repartition(common.parts(prints.sparkSession)), heads.count(), cell_rows, True, counts))
    edges = found.filter("b is not null").select("a", "b")
    twice = each.groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y")
    comp = common.components(edges.union(twice.select(F.xxhash64("x"), F.xxhash64("y")))).withColumnRenamed("node", "fid")
    if not counts:
        return common.written(heads.join(comp, "fid", "left").filter("root is not null or docs > 1").select("fp", F.coalesce("root", "fid").alias("root")))
    links = found.filter("b is null").groupBy(F.col("a").alias("fid")).agg(F.sum("links").alias("near"))
    grouped = heads.join(comp, "fid", "left").join(links, "fid", "left").filter("root is not null or docs > 1")
    return common.written(grouped.select("fp", F.coalesce("root", "fid").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("docs") - 1).alias("links")))


def near_copies(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, class_id, links) of every document: its class of near copies, and how many other documents are near copies of it itself."""
    common.tune(docs.sparkSession)
    prints = common.written(_prints(docs).unionByName(docs.filter("text is null").select("doc_id", common.row_key().alias("key"), F.lit(None).cast("binary").alias("fp"))))
    classes = _classes(prints, cell_rows)
    own = prints.select("fp", "doc_id").filter("fp is not null").join(common.side(classes), "fp")
    names = common.written(own.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    named = common.written(classes.join(names, "root").select("fp", "class_id", "links", F.lit(True).alias("grouped")))
    joined = prints.select("fp", "doc_id").join(common.side(named), "fp", "left")
    return joined.select("doc_id", F.when(F.col("grouped"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_first(docs: DataFrame, origin: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The documents without later copies, with the columns they came with.

    ``origin`` (doc_id, text) has the documents as they came before other steps
    cut them: then documents are near copies by their texts or by those. An id
    that is null or has several texts of different fingerprints in ``origin``
    counts with its text alone.
    """
    common.tune(docs.sparkSession)
    prints = common.written(_prints(docs).filter("fp is not null"))
    if origin is not None:
        # Texts are not shuffled to find those that are still there: a bitmap of ids leaves most others out, the join below the rest.
        mine = common.written(prints.select(F.xxhash64("doc_id").alias("id")).distinct())
        here = origin.select("doc_id", "text").filter("text is not null").filter(common.may_have(F.xxhash64("doc_id"), mine, "id"))
        came = here.select("doc_id", fingerprint(F.col("text")).alias("came"))
        came = came.filter("came is not null").groupBy("doc_id").agg(F.min("came").alias("came"), F.max("came").alias("other")).filter("came = other").select("doc_id", "came")
        both = prints.join(came, "doc_id", "left").select("doc_id", "key", F.explode(F.array_distinct(F.array("fp", F.coalesce("came", "fp")))).alias("fp"))
        prints = common.written(both)
    groups = prints.join(common.side(_classes(prints, cell_rows, False)), "fp").select("key", "doc_id", "root").distinct()
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")).alias("stays")
    groups = common.written(groups)
    best = common.written(groups.groupBy("root").agg(first).select("root", "stays"))
    key, other, copy = common.fresh(docs, "key", "other_key", "copy")
    gone = common.written(groups.join(common.side(best), "root").filter(F.col("key") != F.col("stays.key")).select(F.col("key").alias(other)).distinct())
    kept = common.attach(docs.withColumn(key, common.row_key()), key, gone, other).filter(F.col(other).isNull()).drop(other)
    again = common.written(_prints_again(docs, other))
    if again.limit(1).count():
        marked = common.attach(kept, key, again, other)
        order = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in docs.columns])
        one = marked.filter(F.col(other).isNotNull()).withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).drop(copy)
        kept = marked.filter(F.col(other).isNull()).union(one).drop(other)
    return kept.drop(key)


def _prints_again(docs: DataFrame, name: str) -> DataFrame:
    """Keys of the documents with text that are listed more than once."""
    return docs.filter("text is not null").groupBy(common.row_key().alias(name)).count().filter("count > 1").select(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(common.table(spark, sf_dir, "documents"))
