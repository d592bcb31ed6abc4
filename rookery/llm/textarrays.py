"""Whole-column text work on Arrow string arrays, without a Python step per word.

A word is a maximal run of bytes other than space and TAB..CR; A-Z are
lower-cased first.  A null text is an empty text.  Words are identified by a
64-bit tabulation hash: every byte value has a random number of its own at each of
CHUNK places, which are summed, so two words of up to CHUNK bytes are equal by
chance once in 2**64 whatever their bytes; the sums of a longer word's chunks are
mixed with the chunk's number before they are added.  Where equality must be
exact, ``alike`` compares the bytes behind equal hashes.  Memory is a small multiple of the batch's
bytes, so callers feed ``pieces`` of half a MB.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 32
_RNG = np.random.default_rng(20240611)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A number for every place in a chunk and every byte there, in one row.
_PLACED = _RNG.integers(0, 2**64, (CHUNK, 256), dtype=np.uint64)[:, _LOWER].ravel()
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

PIECE_BYTES, PIECE_ROWS = 1 << 19, 1 << 10
BATCH_BYTES = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES, rows: int = PIECE_ROWS):
    """Row ranges (a, b) of at most ``rows`` rows and ``most`` bytes each, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), a + rows, n)
        yield a, b
        a = b


def bounded(df: DataFrame) -> DataFrame:
    """``df``, of whose session Arrow batches are BATCH_BYTES at most from now on: by rows alone, ten thousand long texts would be one batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) != str(BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory kept for later goes back to the system when a task ends, for its worker lives on."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in order: its hash, its row, its first byte, its end."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first = np.flatnonzero(begins)
    last = np.flatnonzero(ends) + 1
    if not len(first):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    length = last - first
    body = raw[solid]
    at = np.cumsum(length) - length
    place = np.arange(len(body), dtype=np.int64) - np.repeat(at, length)
    key = (place & (CHUNK - 1)) << 8
    key += body
    if length.max() <= CHUNK:
        h = np.add.reduceat(_PLACED[key], at)
    else:
        begin = np.flatnonzero(place % CHUNK == 0)
        number = (place[begin] // CHUNK).astype(np.uint64)
        part = np.add.reduceat(_PLACED[key], begin)
        part = np.where(number > 0, mix(part + number * _STEP), part)
        h = np.add.reduceat(part, np.flatnonzero(number == 0))
    row = np.searchsorted(offsets, first, "right") - 1
    return mix(h + length.astype(np.uint64)), row, first, last


def alike(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` and from ``b`` are the same words, A-Z lower-cased."""
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
    differ = _LOWER[raw[np.repeat(a, length) + place]] != _LOWER[raw[np.repeat(b, length) + place]]
    return np.add.reduceat(differ, at) == 0 if len(at) else np.zeros(0, bool)


def exact(raw: np.ndarray, offsets: np.ndarray, k: int) -> bool:
    """Whether equal hashes stand for equal words, and equal shingle hashes for equal runs of ``k`` words, in these rows."""
    h, row, first, last = words(raw, offsets)
    order = np.argsort(h, kind="stable")
    x, y = order[:-1][h[order[1:]] == h[order[:-1]]], order[1:][h[order[1:]] == h[order[:-1]]]
    length = last - first
    if (length[x] != length[y]).any() or not alike(raw, first[x], first[y], length[x]).all():
        return False
    n = len(offsets) - 1
    s, r = shingles(h, row, n, k)
    count = np.bincount(row, minlength=n)
    start, own = np.cumsum(count) - count, np.bincount(r, minlength=n)
    start = start[r] + np.arange(len(r)) - (np.cumsum(own) - own)[r]
    width = np.minimum(count, k)[r]
    order = np.argsort(s, kind="stable")
    same = s[order[1:]] == s[order[:-1]]
    x, y = order[:-1][same], order[1:][same]
    if (width[x] != width[y]).any():
        return False
    top = max(len(h) - 1, 0)
    return all(((h[np.minimum(start[x] + j, top)] == h[np.minimum(start[y] + j, top)]) | (j >= width[x])).all() for j in range(k))


_COMBINE = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``k`` words of a row, in order, repeats included.

    A row with 1 to k-1 words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    count = np.bincount(row, minlength=n_rows)
    m = len(h)
    if m >= k:
        s = h[: m - k + 1] * _COMBINE[0]
        for j in range(1, k):
            s = s + h[j : m - k + 1 + j] * _COMBINE[j]
        keep = row[: m - k + 1] == row[k - 1 :]
        s, r = mix(s[keep]), row[: m - k + 1][keep]
    else:
        s, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        start = np.cumsum(count) - count
        extra = np.empty(len(few), np.uint64)
        for c in range(1, k):
            own = count[few] == c
            first = start[few[own]]
            v = np.full(len(first), c, np.uint64)
            for j in range(c):
                v = v + h[first + j] * _COMBINE[j]
            extra[own] = v
        s, r = np.concatenate([s, mix(extra)]), np.concatenate([r, few])
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r
