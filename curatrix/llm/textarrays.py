"""Vectorised word and hash kernels over Arrow string buffers.

Texts arrive in Python as Arrow batches; everything here works on the batch's
UTF-8 bytes with numpy, so no per-word Python object is ever made.  A *word*
is a maximal run of bytes that a 256-entry table marks, and never crosses a
row.  Word hashes are 64-bit polynomial hashes of the word's bytes, mixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_LONG_WORD = 4096
_CHUNK = 1 << 15
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

#: Words are what white space (bytes up to 0x20) separates.
SPACED = np.arange(256) > 32
#: Words are runs of ASCII letters, digits and any non-ASCII character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    if len(array) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's index of each row (with the total last)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = np.zeros(len(buf) + 2, bool)
    mask[1:-1] = table[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(mask[1:-1] & (cut[:-1] | ~mask[:-2]))
    ends = np.flatnonzero(mask[1:-1] & (cut[1:] | ~mask[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they stand."""
    if not _tables:
        _tables.extend((_powers(_P, _CHUNK + _LONG_WORD + 1), _powers(_PINV, _CHUNK + _LONG_WORD + 1)))
    up, down = _tables
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    acc = np.zeros(_CHUNK + _LONG_WORD + 1, np.uint64)
    cuts = np.searchsorted(starts, np.arange(starts[0], starts[-1] + _CHUNK, _CHUNK)) if len(starts) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(starts)]):
        if lo == hi:
            continue
        base = starts[lo]
        long_ = np.flatnonzero(size[lo:hi] > _LONG_WORD)
        keep = slice(None) if not len(long_) else np.flatnonzero(size[lo:hi] <= _LONG_WORD)
        s, e = starts[lo:hi][keep] - base, ends[lo:hi][keep] - base
        if len(e):
            span = int(e[-1])
            part = buf[base : base + span].astype(np.uint64)
            part += np.uint64(1)
            part *= down[:span]
            np.cumsum(part, out=acc[1 : span + 1])
            out[lo:hi][keep] = (acc[e] - acc[s]) * up[s]
        for k in long_:
            word = buf[starts[lo + k] : ends[lo + k]].tobytes()
            out[lo + k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix64(out + size.astype(np.uint64))
