"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its letter 1- to 3-grams, hashed
into ``DIMS`` dimensions and scaled to length 1. Every language has several
centroids, clustered from labelled rows by spherical k-means; a text gets the
language of the centroid of largest cosine. It is rejected when it lies
about as far from every centroid as texts of its length in a language without
centroids do; that distance is learnt by leaving out each language in turn.

Document frequencies are counted over all documents. Only the centroids and
distances are fitted, on a sample of labelled rows that ``per_language``
bounds; the sample is a hash threshold on the id, so it is the same at any
partitioning.

Defined results: null or blank text, or text without letters, has similarity 0
and is rejected (lang null). Rows with null ``lang`` are not used for fitting
and are classified as any other. Without any labelled row, all are rejected.
Equal rows get equal results. Extra columns are kept by ``keep_known`` and
ignored otherwise. Equal cosines go to the alphabetically first language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textarrays import column, slices

BITS = 13
DIMS = 1 << BITS
_ROWS = 64


def _letters() -> np.ndarray:
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_table: list[np.ndarray] = []


def counts(texts: list[bytes]) -> np.ndarray:
    """Matrix of hashed letter n-gram counts, a row for each text."""
    if not _table:
        _table.append(_letters())
    coded = [t.decode("utf-8", "replace").encode("utf-32-le") for t in texts]
    sizes = np.array([len(c) // 4 + 1 for c in coded])
    x = np.frombuffer(b" \0\0\0".join(coded) + b" \0\0\0", np.uint32)
    x = _table[0][x]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    space = x == 32
    keep = ~(space & np.r_[True, space[:-1]])
    keep |= np.r_[True, row[1:] != row[:-1]] & ~space
    x, row = x[keep], row[keep]
    out = np.zeros(len(texts) * DIMS, np.float32)
    if not len(x):
        return out.reshape(len(texts), DIMS)
    h, one = x * np.uint32(0x9E3779B1), x != 32
    for n in (1, 2, 3):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n - 1 :] * np.uint32(0xC2B2AE35)
        m = len(h)
        if m <= 0:
            break
        ok = one if n == 1 else row[:m] == row[n - 1 :]
        bucket = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64)
        out += np.bincount(row[:m][ok] * DIMS + bucket[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIMS)


def _groups(buf: np.ndarray, offsets: np.ndarray):
    """Byte strings of the rows, in groups that bound the matrix."""
    for lo, hi in slices(offsets, 1 << 19):
        for a in range(lo, hi, _ROWS):
            b = min(hi, a + _ROWS)
            yield a, b, [buf[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


@dataclass
class Model:
    """idf by dimension; centroids with their languages; least similarity by log2 of the number of n-grams."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def weigh(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = tf.sum(1)
        w = np.log1p(tf) * self.idf
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        return w, n

    def classify(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best centroid, its cosine, and whether it is near enough."""
        w, n = self.weigh(tf)
        if not len(self.langs):
            return np.zeros(len(tf), np.int64), np.zeros(len(tf), np.float32), np.zeros(len(tf), bool)
        sim = w @ self.centroids.T
        best = sim.argmax(1)
        top = sim[np.arange(len(tf)), best]
        return best, top, (n > 0) & (top >= self.floor[_bin(n)])


def _bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 15)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each dimension occurs, and their number."""

    def run(it):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in it:
            buf, offs = column(batch.column(0))
            for _, _, texts in _groups(buf, offs):
                df += (counts(texts) > 0).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "df": pa.array([df.tolist()], pa.list_(pa.int64()))})

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v.as_py()) for v in t["df"]], axis=0)
        return pa.table({"n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "df": pa.array([total.tolist()], pa.list_(pa.int64()))})

    total, n = np.zeros(DIMS, np.int64), 0
    each = docs.select("text").mapInArrow(common.lean(run), "part int, n long, df array<long>")
    for r in each.withColumn("part", F.spark_partition_id() % 16).groupBy("part").applyInArrow(add, "n long, df array<long>").collect():
        total, n = total + np.asarray(r["df"]), n + r["n"]
    return total, n


def _kmeans(x: np.ndarray, k: int, spread: bool, rounds: int = 12) -> np.ndarray:
    """Spherical k-means without random choice: from farthest-first seeds, or from rows spread evenly by closeness to the mean."""
    mean = x @ x.mean(0)
    if spread:
        seeds = list(dict.fromkeys(np.argsort(mean, kind="stable")[(np.arange(k) * 2 + 1) * len(x) // (2 * k)].tolist()))
    else:
        seeds = [int(mean.argmax())]
        near = x @ x[seeds[0]]
        while len(seeds) < min(k, len(x)):
            seeds.append(int(near.argmin()))
            near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


def _centroids(x: np.ndarray, k: int, least: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of ``x`` that each hold at least a share ``least`` of its rows, but for the largest; the rows they hold.

    A few texts of another language under a wrong label must not be a centroid
    of their own: it would vouch for that language. Farthest-first seeds find
    such rows; those in small clusters are left out and the rest clustered.
    """
    enough, rows = least * len(x), np.arange(len(x))
    for spread in (False, False, False, True):
        c = _kmeans(x[rows], k, spread)
        own = (x[rows] @ c.T).argmax(1)
        size = np.bincount(own, minlength=len(c))
        big = (size == 0) | (size >= min(enough, size.max()))  # equal rows leave all but one of their centroids without rows
        rows = rows[big[own]]
        if spread:
            return c[big], rows
    raise AssertionError("the last round returns")


def _spans(text: bytes, lang: int, salt: int) -> list[bytes]:
    """Pieces of 1, 2, 4 ... words from a text, to learn what distance is usual at each length."""
    w = text.split()
    out, n = [], 1
    while n < len(w):
        at = (salt * 2654435761 + n * 40503) % (len(w) - n + 1)
        out.append(b" ".join(w[at : at + n]))
        n *= 2
    return out + [text]


def fit(docs: DataFrame, per_language: int = 300, clusters: int = 4, slack: float = 0.8, margin: float = 1.5) -> Model:
    """Fit on at most about ``per_language`` labelled rows of each language.

    A text of some length is rejected below ``margin`` times the similarity
    that 10 % of a language's pieces of that length exceed when its own
    centroids are left out (of the languages, the largest), but not above
    ``slack`` times the similarity that 99 % of all pieces of that length
    exceed. With one language only the latter is known.
    """
    df, n = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    model = Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(16, np.float32))
    if not sizes:
        return model
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / size)).otherwise(share)
    chosen = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < share * (1 << 30)
    sample: dict[str, list[bytes]] = {}
    for r in labelled.filter(chosen).select("lang", "text").collect():
        sample.setdefault(r["lang"], []).append(r["text"].encode())
    return _fitted(model, sample, clusters, slack, margin)


def _fitted(model: Model, sample: dict[str, list[bytes]], clusters: int, slack: float, margin: float) -> Model:
    """``model`` with centroids and floor from the texts of each language."""
    cents, pieces = [], []
    for lang in sorted(sample):
        texts = sorted(sample[lang])
        tf = np.concatenate([counts(texts[i : i + _ROWS]) for i in range(0, len(texts), _ROWS)])
        some = np.flatnonzero(tf.sum(1) > 0)
        if not len(some):
            continue
        c, held = _centroids(model.weigh(tf[some])[0], clusters)
        cents.append(c)
        model.langs += [lang] * len(c)
        pieces.append((lang, [p for i in some[held].tolist() for p in _spans(texts[i], 0, i)]))
    model.centroids = np.concatenate(cents) if cents else model.centroids
    low: list[list[float]] = [[] for _ in range(16)]
    left_out = np.zeros(16)
    for lang, spans in pieces:
        own, far = np.array(model.langs) == lang, [[] for _ in range(16)]
        for i in range(0, len(spans), _ROWS):
            w, n = model.weigh(counts(spans[i : i + _ROWS]))
            sim = w @ model.centroids.T
            for b, s, f in zip(_bin(n), sim.max(1), sim[:, ~own].max(1, initial=0)):
                low[b].append(float(s))
                far[b].append(float(f))
        left_out = np.maximum(left_out, [np.quantile(v, 0.9) if v else 0 for v in far])
    usual = np.array([np.quantile(v, 0.01, method="lower") * slack if v else np.nan for v in low], np.float32)
    floor = np.minimum(usual, margin * left_out).astype(np.float32) if len(pieces) > 1 else usual
    known = np.flatnonzero(~np.isnan(floor))
    if len(known):
        model.floor = floor[known][np.searchsorted(known, np.arange(16)).clip(max=len(known) - 1)]
    return model


def label(docs: DataFrame, model: Model):
    """Column (lang, similarity, accepted) over ``text``."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("similarity", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang string, similarity double, accepted boolean")
    def classify(text: pa.Array) -> pa.Array:
        m = share.value
        buf, offs = column(text)
        langs, sims, oks = [], [], []
        for _, _, texts in _groups(buf, offs):
            best, top, ok = m.classify(counts(texts))
            langs += [m.langs[b] if k else None for b, k in zip(best, ok)]
            sims.append(top)
            oks.append(ok)
        sim = np.concatenate(sims).astype(np.float64) if sims else np.zeros(0)
        ok = np.concatenate(oks) if oks else np.zeros(0, bool)
        common.trim()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.round(sim, 4)), pa.array(ok)], fields=list(kind))

    return classify(F.col("text"))


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, lang, similarity, accepted) of every document."""
    common.tune(docs.sparkSession)
    return docs.select("doc_id", label(docs, fit(docs, **how)).alias("r")).select("doc_id", "r.lang", "r.similarity", "r.accepted")


def keep_known(docs: DataFrame, **how) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    common.tune(docs.sparkSession)
    (mark,) = common.fresh(docs, "language")
    return docs.withColumn(mark, label(docs, fit(docs, **how))).filter(F.col(mark)["accepted"]).drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
