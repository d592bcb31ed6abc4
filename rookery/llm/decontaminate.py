"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact check.

A benchmark item of L words is looked for in every window of L words of a
document (the whole text, where it is shorter).  Item and window are bags of
five-word shingles; a candidate counts if their weighted Jaccard similarity
(sum of minima over sum of maxima of the shingles' counts) is at least 0.8.

Which windows meet which items is bounded without loss: a window of ``a`` shingles and an
item of ``n`` at similarity t share t (a + n) / (1 + t) of them, at least t n, so

- a window with fewer shingles of the benchmark than that meets no item, and
- one of any n - t n + 1 shingles of the item is in the window; of these *keys*, the
  item's rarest in the benchmark, an inverted list leads from windows to items.

The 128-bit SimHash of a bag is the sign of the sum of its shingles' random vectors, read
for all windows from running sums over a stretch of the document.  Bags of similarity 0.8
differ in about 19 bits, so fingerprints within RADIUS bits are candidates.  128 bits are 16
blocks, and two fingerprints within RADIUS bits differ by at most RADIUS // 16 in some
block, so only windows near an item in some block are measured in full, and no pair within the radius is
lost.  (Blocks alone would prune little at this radius, 92 % of random pairs pass them; the bounds above do that.)

The benchmark's tables are built once and broadcast; ``max_items`` and ``max_words`` bound
what is sent, and a larger benchmark is worked off in groups of items, one after the other.

Words are lower-cased runs of letters and digits, so punctuation and markup
around a passage do not hide it.

Cases: null and empty texts and items match nothing.  An item of fewer than five
words is one shingle, as is a window of its size.  Repeated documents and items
each count; a null item_id is an item like others.  An empty benchmark finds nothing; an empty table gives no rows.
Extra columns are left out (``leaks``) or kept (``keep_clean``).  A very long text costs memory in
proportion to its number of words, as hashes; running sums are held for STRETCH words at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.textarrays import bounded, column_bytes, mix, pieces, released, shingles, words
from rookery.plans.durable import materialize

K = 5
BITS = 128
BLOCKS = 16
RADIUS = 38
_SEED = np.random.default_rng(4242).integers(1, 2**63, BITS // 64, dtype=np.uint64)
_PLAIN = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    _PLAIN[_b] = _b
STRETCH = 8192


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the letter-and-digit words of a column."""
    h, row, _, _ = words(_PLAIN[raw], offsets)
    return h, row


def vectors(shingle: np.ndarray) -> np.ndarray:
    """The +1/-1 vectors of shingles, one int8 row of BITS numbers each."""
    bits = np.stack([mix(shingle ^ s) for s in _SEED], axis=1)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Packed signs of vector sums, BITS // 8 bytes each."""
    return np.packbits(sums > 0, axis=-1)


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(nx[i], ny[j]).sum()
    whole = len(a) + len(b) - shared
    return shared / whole if whole else 0.0


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of fingerprints are within RADIUS bits: by a near block first, then in full."""
    blocks = np.bitwise_count(a ^ b)
    out = np.zeros(len(blocks), bool)
    some = np.flatnonzero(blocks.min(1, initial=255) <= RADIUS // BLOCKS)
    out[some] = blocks[some].sum(1) <= RADIUS
    return out


def needed(a: int, n: int, threshold: float) -> int:
    """The least number of shared shingles with which bags of ``a`` and ``n`` reach the threshold."""
    return math.ceil(threshold * (a + n) / (1 + threshold) - 1e-9)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64), len(keys)]


class Benchmark:
    """Items as bags of shingles, their fingerprints, and inverted lists from shingles to items."""

    def __init__(self, rows: list[tuple[object, str | None]], threshold: float = 0.8):
        self.threshold = threshold
        raw, offsets = column_bytes(pa.array([t for _, t in rows], pa.large_string()))
        h, row = plain_words(raw, offsets)
        self.ids = [i for i, _ in rows]
        self.words = np.bincount(row, minlength=len(rows))
        s, r = shingles(h, row, len(rows), K)
        self.shingles, self.start = s, np.searchsorted(r, np.arange(len(rows) + 1))
        self.prints = np.zeros((len(rows), BITS // 8), np.uint8)
        for a in range(0, len(rows), 256):  # running sums of a few items at a time
            b = min(a + 256, len(rows))
            low = self.start[a]
            sums = np.zeros((self.start[b] - low + 1, BITS), np.int32)
            np.cumsum(vectors(s[low : self.start[b]]), axis=0, dtype=np.int32, out=sums[1:])
            self.prints[a:b] = fingerprints(sums[self.start[a + 1 : b + 1] - low] - sums[self.start[a:b] - low])
        long = self.words[r] >= K
        self.known, often = np.unique(s[long], return_counts=True)
        # Keys: of each item its rarest shingles, as many as no alike window can do without.
        s, r = s[long], r[long]
        order = np.lexsort((s, often[np.searchsorted(self.known, s)], r))
        s, r = s[order], r[order]
        size = np.bincount(r, minlength=len(rows))
        place = np.arange(len(r)) - (np.cumsum(size) - size)[r]
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        keep = place <= (size - least)[r]
        s, r = s[keep], r[keep]
        order = np.lexsort((r, s))
        s, r = s[order], r[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])] if len(s) else np.zeros(0, bool)
        s, self.items = s[new], r[new]
        cut = _runs(s)
        self.keys, self.lists = s[cut[:-1]], cut
        # Items of fewer than K words: one shingle each, by number of words.
        self.short = {int(n): np.flatnonzero(self.words == n) for n in range(1, K) if (self.words == n).any()}

    def bag(self, item: int) -> np.ndarray:
        return self.shingles[self.start[item] : self.start[item + 1]]

    def touched(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for every shingle that is a key of an item."""
        found = member(self.keys, s)
        place = np.flatnonzero(found >= 0)
        key = found[place]
        size = self.lists[key + 1] - self.lists[key]
        at = np.repeat(self.lists[key] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(place, size), self.items[at]


def member(known: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The place of each value among sorted ``known`` ones, -1 where it is none."""
    if not len(known):
        return np.full(len(s), -1)
    at = np.searchsorted(known, s)
    at[at == len(known)] = 0
    return np.where(known[at] == s, at, -1)


def _starts(place: np.ndarray, width: int, m: int) -> np.ndarray:
    """The first shingles of all windows of ``width`` among ``m`` shingles that hold one of the sorted places."""
    low, high = np.maximum(place - width + 1, 0), np.minimum(place, m - width) + 1
    low = np.maximum(low, np.r_[0, np.maximum.accumulate(high)[:-1]])
    size = np.maximum(high - low, 0)
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def matches(h: np.ndarray, bench: Benchmark, threshold: float) -> list[tuple[int, int, int, float]]:
    """(item's number, first word, words, similarity) of the best window for each item in one document's words."""
    best: dict[int, tuple[float, int, int]] = {}

    def note(item: int, similarity: float, start: int, n: int) -> None:
        if similarity >= threshold and (item not in best or (-similarity, start) < (-best[item][0], best[item][1])):
            best[item] = (similarity, start, n)

    m = len(h)
    for n, items in bench.short.items():
        if m >= n:
            grams, _ = shingles_of_width(h, n)
            for item in items.tolist():
                first = np.flatnonzero(grams == bench.bag(item)[0])
                if len(first):
                    note(item, 1.0, int(first[0]), n)
    if m >= K and len(bench.keys):
        s, _ = shingles(h, np.zeros(m, np.int64), 1, K)
        place, item = bench.touched(s)
        if len(place):
            hits = np.r_[0, np.cumsum(member(bench.known, s) >= 0)]
            order = np.lexsort((place, item))
            place, item = place[order], item[order]
            cut = _runs(item)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                i = int(item[lo])
                bag = bench.bag(i)
                width = min(len(bag), len(s))
                least = needed(width, len(bag), threshold)
                start = _starts(place[lo:hi], width, len(s))
                start = start[hits[start + width] - hits[start] >= max(least, 1)]
                while len(start):
                    some = start[: np.searchsorted(start, start[0] + STRETCH)]
                    start = start[len(some) :]
                    low = int(some[0])
                    sums = np.zeros((int(some[-1]) + width - low + 1, BITS), np.int32)
                    np.cumsum(vectors(s[low : low + len(sums) - 1]), axis=0, dtype=np.int32, out=sums[1:])
                    prints = fingerprints(sums[some - low + width] - sums[some - low])
                    for w in some[near(prints, bench.prints[i][None])].tolist():
                        note(i, bag_similarity(s[w : w + width], bag), w, width + K - 1)
    return [(item, start, n, float(x)) for item, (x, start, n) in sorted(best.items())]


def shingles_of_width(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n words as the one shingle that an item of n < K words is."""
    m = len(h) - n + 1
    rows = np.repeat(np.arange(m), n)
    return shingles(h[np.arange(m)[:, None] + np.arange(n)].ravel(), rows, m, K)


def _found(texts: pa.Array, bench: Benchmark, threshold: float) -> Iterator[tuple[int, list]]:
    """(row, matches) of the rows of a column in which items are found."""
    raw, offsets = column_bytes(texts)
    for a, b in pieces(offsets):
        h, row = plain_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = np.cumsum(np.bincount(row, minlength=b - a))
        look = np.arange(b - a)
        if not bench.short:  # documents without any key need no closer look
            s, r = shingles(h, row, b - a, K)
            look = np.unique(r[member(bench.keys, s) >= 0])
        for d in look.tolist():
            found = matches(h[ends[d - 1] if d else 0 : ends[d]], bench, threshold)
            if found:
                yield a + d, found


def _groups(benchmark: DataFrame, max_items: int, max_words: int) -> list[DataFrame]:
    """The benchmark in groups within the bounds."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // max_items), -(-size // (4 * max_words)))
    if groups == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) for g in range(groups)]


def leaks(documents: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, max_items: int = 20_000, max_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity of every item found in a document.

    One row per document and item, for the window most alike (ties: the first).
    """
    kinds = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, at long, first_word long, n_words long, similarity double"

    def search(rows: list) -> tuple[DataFrame, object]:
        sent = documents.sparkSession.sparkContext.broadcast(Benchmark(rows, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                rows = [(d, *m) for d, found in _found(batch.column("text"), sent.value, threshold) for m in found]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.float64())], ["doc_id", "at", "first_word", "n_words", "similarity"])

        # Items travel by number; there are at most ``max_items`` names to give back.
        names = documents.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"at long, item_id {kinds[1]}")
        return documents.select("doc_id", "text").mapInArrow(run, schema).join(F.broadcast(names), "at").select("doc_id", "item_id", "first_word", "n_words", "similarity"), sent

    documents, groups, found = bounded(documents), _groups(benchmark, max_items, max_words), None
    for part in groups:
        one, sent = search([(r[0], r[1]) for r in part.select("item_id", "text").collect()])
        if len(groups) > 1:  # one group at a time is held
            one = materialize(one, "leaks")
            sent.unpersist()
        found = one if found is None else found.unionByName(one)
    return found


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, max_items: int = 20_000, max_words: int = 2_000_000) -> DataFrame:
    """The documents in which no benchmark item is found, with their own columns."""
    spark = documents.sparkSession

    def clean(rows: list):
        sent = spark.sparkContext.broadcast(Benchmark(rows, threshold))

        @F.arrow_udf("boolean")
        def is_clean(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            out[[d for d, _ in _found(texts, sent.value, threshold)]] = False
            return pa.array(out)

        return is_clean, sent

    documents, groups = bounded(documents), _groups(benchmark, max_items, max_words)
    for part in groups:
        is_clean, sent = clean([(r[0], r[1]) for r in part.select("item_id", "text").collect()])
        documents = documents.where(is_clean("text"))
        if len(groups) > 1:
            documents = materialize(documents, "clean")
            sent.unpersist()
    return documents
