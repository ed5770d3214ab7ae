"""Vectorised text primitives over Arrow string columns.

UTF-8 keeps every non-ASCII code point in bytes of 0x80 and above, so word
classes that keep or drop all of non-ASCII can be decided byte by byte.  All
functions work on *slabs*: half a megabyte of consecutive rows, never a part
of a row, so that memory is bounded by the slab size plus the longest text.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time.
SLAB_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z is lower case.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: `[^\x20\x09-\x0D]`
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_RNG = np.random.default_rng(0x5EED)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of more bytes are hashed by BLAKE2b, others by chained mixes of eight bytes.
LONG = 64
#: A key for each length, and a mask for the last eight bytes.
_KEY = _RNG.integers(1, 2**63, LONG + 2, dtype=np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def released(run: Callable) -> Callable:
    """A batch function after which the worker gives memory that it no longer needs back to the system: workers live on, and their executors' other tasks need it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o.astype(np.int64)


def slabs(column: pa.Array, size: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows."""
    data, offs = buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of kept bytes, and each row's first word."""
    m = keep[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    firsts = offs[(offs > 0) & (offs < len(m))]
    s[firsts] = m[firsts]
    e[firsts - 1] = m[firsts - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offs)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number; behind the end stand zeros."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", buffer=wide, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes.

    Spans of one length up to eight bytes never share a hash, since `mix` is a
    bijection; longer ones are chained eight bytes at a time, and those beyond
    `LONG` bytes take BLAKE2b, so no repeated structure cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size, at = ends - starts, eights(data)
    h = mix((at[starts] & _MASK[np.minimum(size, 8)]) ^ _KEY[np.minimum(size, LONG + 1)])
    live, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        more = at[starts[live] + done] & _MASK[np.minimum(size[live] - done, 8)]
        h[live] = mix((h[live] + _KEY[done // 8]) * _MIX[done // 8] ^ more)
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for words given as strings."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if raw else ends
    return word_hashes(data, starts, ends)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles (fewer words: the whole sequence; none: empty)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs, NONSPACE)
    w = word_hashes(data, starts, ends)
    n = len(w)
    if n >= width:
        acc = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            acc += w[j : n - width + 1 + j] * _MIX[j]
        acc = mix(acc + np.uint64(width))
    else:
        acc = np.zeros(0, np.uint64)
    out = []
    for r in range(len(offs) - 1):
        a, b = first[r], first[r + 1]
        if b - a >= width:
            out.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            one = (w[a:b] * _MIX[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n words, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and each row's count."""
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
