"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts are quantised on a log scale; an n-gram of level q is in the filter
once for each level 1 to q, so its level is read back by probing levels until
one is missing, and its count is the middle of that level.  The filter is cut
into segments by the n-gram's hash, each sized by what it holds and built by the
task that counts the segment, so every n-gram counts at every size.  Up to ``broadcast_bits``
the filters are broadcast.  Beyond that they stay where they are: chunks of documents (runs of rows
of CHUNK bytes) send their distinct n-grams to the segments and get the levels back, which gives
the same scores.  A filter is asked once for each n-gram of a piece, in the order of the segments.

Counting: each task counts its own words and word pairs and sends one packed
row per segment, so a word that fills the corpus costs a row per task.  Words and pairs are told
apart by 64-bit hashes (see ``textarrays``): among V distinct ones V * V / 2**65 pairs share a hash by chance.

Scores.  The base needs exact word counts.  The ``head_words`` most frequent words
at most are broadcast with theirs; rarer tokens are joined with the counted
words.  The model mixes the filter's pair counts with add-one word
probabilities: ``(c(v,w) + k p(w)) / (c(v) + k)`` with ``k = K0 * c(v) ** K1``, the
number of distinct followers that a word of that count usually has.

Cases: null and empty texts have one token, the end.  Without training rows all
counts are zero and base and model are those of one unseen token kind.  Repeated
rows each get their scores.  A very long text is a piece of its own.  An empty table gives no rows.  Extra columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.textarrays import bounded, column_bytes, mix, pieces, released, words
from rookery.plans.durable import materialize

END, START = np.uint64(0xE0D), np.uint64(0x57A27)
WORD, PAIR = 1, 2
BASE = 1.5
PROBES = 6
BITS_PER_ENTRY = PROBES / math.log(2)
K0, K1 = 3.0, 0.85
#: Counts a task holds before it sends them on.
FLUSH = 1_000_000
#: Bytes of text that ask the segments together where the filters are not broadcast.
CHUNK = 1 << 24
_SALT = np.random.default_rng(99).integers(1, 2**63, 128, dtype=np.uint64)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def token_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every token: the words of a row, then its end."""
    n = len(offsets) - 1
    h, row, _, _ = words(raw, offsets)
    count = np.bincount(row, minlength=n)
    token = np.full(len(h) + n, END, np.uint64)
    last = np.cumsum(count + 1) - 1
    inside = np.ones(len(token), bool)
    inside[last] = False
    token[inside] = h
    return token, np.repeat(np.arange(n), count + 1)


def before(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each, START for a row's first."""
    prev = np.empty_like(token)
    if len(token):
        prev[0] = START
        prev[1:] = np.where(row[1:] == row[:-1], token[:-1], START)
    return prev


def pairs_of(prev: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(prev * _A + token * _B)


def _tally(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        h = np.sort(h)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.r_[first, len(h)])
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def levels(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)) of counts of at least one."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The mean of a level's smallest and largest count; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**level - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _places(h: np.ndarray, level: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bit places of (n-gram, level) in a segment of that many bits, one probe at a time."""
    a = mix(h ^ _SALT[level])
    step = (a >> np.uint64(32)) | np.uint64(1)
    at = a & np.uint64(0xFFFFFFFF)
    for _ in range(PROBES):
        yield ((at & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)
        at = at + step


def build_segment(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The packed filter of one segment's n-grams, sized by what they need: its number of bits, then the bits."""
    q = levels(count)
    n_bits = max(64, int(q.sum() * BITS_PER_ENTRY) + 1)
    bits = np.zeros((n_bits + 7) // 8 * 8, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = h[q >= level]
        for place in _places(own, np.full(len(own), level), np.uint64(n_bits)):
            bits[place.astype(np.int64)] = 1
    return np.frombuffer(np.uint64(n_bits).tobytes() + np.packbits(bits, bitorder="little").tobytes(), np.uint8)


#: ``middle`` of every level that there may be.
MIDDLE = middle(np.arange(len(_SALT)))


def probe(data: np.ndarray, h: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each n-gram whose segment has ``size`` bits from bit ``base`` of ``data``; 0 where it is not held."""
    out = np.zeros(len(h), np.uint8)
    live = np.flatnonzero(size > 0)
    own, first, wide = h[live], base[live].astype(np.uint64), size[live]
    for level in range(1, len(_SALT)):
        if not len(live):
            break
        a = mix(own ^ _SALT[level])
        # 32 bits, whose sums wrap around as the places of ``_places`` do.
        step, at = (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), a.astype(np.uint32)
        kept, f, w, hit = np.arange(len(live)), first, wide, np.ones(len(live), bool)
        for _ in range(PROBES):
            bit = at * w
            bit >>= np.uint64(32)
            bit += f
            hit &= (data[(bit >> np.uint64(3)).view(np.int64)] >> (bit.astype(np.uint8) & np.uint8(7))) & np.uint8(1) != 0
            at += step
            if 4 * np.count_nonzero(hit) < 3 * len(hit):  # those that are out are taken along as long as they are few
                kept, f, w, at, step = kept[hit], f[hit], w[hit], at[hit], step[hit]
                hit = np.ones(len(kept), bool)
        kept = kept[hit]
        live, own, first, wide = live[kept], own[kept], first[kept], wide[kept]
        out[live] = level
    return out


def probe_segment(blob: bytes | None, h: np.ndarray) -> np.ndarray:
    """The levels of n-grams of one packed segment."""
    if not blob:
        return np.zeros(len(h), np.uint8)
    size = np.full(len(h), np.frombuffer(blob[:8], np.uint64)[0])
    return probe(np.frombuffer(blob, np.uint8)[8:], h, np.zeros(len(h), np.int64), size)


class LogFrequencyFilter:
    """All segments of one kind of n-gram, side by side."""

    def __init__(self, segments: pa.Table, shift: int):
        """``segments``: segment and bits, the packed filter of each."""
        n = 1 << shift
        self.shift = np.uint64(64 - shift)
        self.bits, self.start = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.data = np.zeros(pc.sum(pc.binary_length(segments["bits"])).as_py() or 1, np.uint8)
        at = 0
        for batch in segments.to_batches():
            for s, blob in zip(batch.column("segment").to_pylist(), batch.column("bits"), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.uint8)
                self.bits[s], self.start[s] = own[:8].view(np.uint64)[0], 8 * at
                self.data[at : at + len(own) - 8] = own[8:]
                at += len(own) - 8

    def level(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 where it is not held."""
        seg = (h >> self.shift).astype(np.int64)
        return probe(self.data, h, self.start[seg], self.bits[seg])


class Levels:
    """Levels that a chunk was sent for its sorted, distinct n-grams, in place of a filter."""

    def __init__(self, h: np.ndarray, level: np.ndarray):
        self.h, self.of = h, level

    def level(self, h: np.ndarray) -> np.ndarray:
        return self.of[np.searchsorted(self.h, h)] if len(h) else np.zeros(0, np.uint8)


@dataclass
class Model:
    """What workers need: exact counts of frequent words, filters for the rest."""

    n: int
    v: int
    head: np.ndarray
    head_count: np.ndarray
    pairs: LogFrequencyFilter | Levels | None
    words: LogFrequencyFilter | Levels | None

    @property
    def starts(self) -> int:
        """Training rows: each has one end."""
        own = self.head_count[self.head == END]
        return int(own[0]) if len(own) else 0

    def in_head(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each token is a head word, which one)."""
        at = np.searchsorted(self.head, token)
        at[at == len(self.head)] = 0
        return self.head[at] == token if len(self.head) else np.zeros(len(token), bool), at

    def count(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is exact): exact for head words, the filter's for others."""
        token, back = np.unique(token, return_inverse=True)
        known, at = self.in_head(token)
        out = np.zeros(len(token))
        out[known] = self.head_count[at[known]]
        out[~known] = MIDDLE[self.words.level(token[~known])]
        return out[back], known[back]

    def log10(self, token: np.ndarray, prev: np.ndarray, count: np.ndarray, prev_count: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it."""
        single = (count + 1) / (self.n + self.v + 1)
        both = np.zeros(len(token))
        ask = prev_count > 0
        pair, back = np.unique(pairs_of(prev[ask], token[ask]), return_inverse=True)
        both[ask] = MIDDLE[self.pairs.level(pair)][back]
        both = np.minimum(both, prev_count)
        k = K0 * np.maximum(prev_count, 1) ** K1
        return np.log10((both + k * single) / (prev_count + k))


def by_segment(h: np.ndarray, shift: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The segments that sorted hashes lie in, and from where to where."""
    seg = (h >> np.uint64(64 - shift)).astype(np.int32)
    cut = np.r_[np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else [], len(seg)].astype(np.int64)
    return seg[cut[:-1]], list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def packed_counts(n: np.ndarray) -> bytes:
    """A byte for each count; behind them, eight bytes for each that is 255 or more, in order."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def unpacked_counts(blob: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(blob, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(blob, "<i8", offset=size)
    return n


def _counting(shift: int):
    """Packed counts of a task's words and pairs, one row per kind and segment."""

    def rows(kind: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        has, cut = by_segment(h, shift)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(has), kind, np.int32)),
                pa.array(has),
                pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([packed_counts(n[a:b]) for a, b in cut], pa.binary()),
            ],
            ["kind", "segment", "hashes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], PAIR: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    yield rows(kind, *_tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
                    parts.clear()

        for batch in released(batches):
            raw, offsets = column_bytes(batch.column("text"))
            for a, b in pieces(offsets):
                token, row = token_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held[WORD].append(_tally(token))
                held[PAIR].append(_tally(pairs_of(before(token, row), token)))
                size += len(held[WORD][-1][0]) + len(held[PAIR][-1][0])
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def train(documents: DataFrame, *, head_words: int = 1 << 20, broadcast_bits: int = 1 << 30, per_segment: int = 1 << 18) -> tuple[Model, DataFrame, int, DataFrame, int]:
    """(model, counted words as packed rows, the smallest count of a head word, filters, shift of their segments).

    The model is without filters where these have more than ``broadcast_bits`` bits.
    """
    docs = bounded(documents).where(~held_out(F.col("doc_id"))).select("text")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Segments become more as the text grows, so none outgrows the task that counts it.
    shift = max(4, math.ceil(math.log2(max(n_bytes / 6, 1) / per_segment + 1)))

    def reduce(table: pa.Table) -> pa.Table:
        kind, segment = table["kind"][0].as_py(), table["segment"][0].as_py()
        hashes = table["hashes"].to_pylist()
        n = np.concatenate([unpacked_counts(c, len(x) // 8) for x, c in zip(hashes, table["counts"].to_pylist(), strict=True)])
        h, n = _tally(np.frombuffer(b"".join(hashes), np.uint64), n)
        words_too = kind == WORD
        out = {
            "kind": pa.array([kind], pa.int32()),
            "segment": pa.array([segment], pa.int32()),
            "distinct": pa.array([len(h)], pa.int64()),
            "total": pa.array([int(n.sum())], pa.int64()),
            "bits": pa.array([None if words_too else build_segment(h, n).tobytes()], pa.binary()),
            "hashes": pa.array([h.tobytes() if words_too else None], pa.binary()),
            "counts": pa.array([n.tobytes() if words_too else None], pa.binary()),
            # How many words have a count of at least 2**i: from this the head is chosen.
            "at_least": pa.array([[int((n >= 1 << i).sum()) for i in range(40)] if words_too else None], pa.list_(pa.int64())),
        }
        return pa.table(out)

    packed = docs.mapInArrow(_counting(shift), "kind int, segment int, hashes binary, counts binary")
    counted = packed.groupBy("kind", "segment").applyInArrow(reduce, "kind int, segment int, distinct long, total long, bits binary, hashes binary, counts binary, at_least array<long>")
    counted = materialize(counted, "language-model")
    sums = counted.where(f"kind = {WORD}").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), *(F.coalesce(F.sum(F.col("at_least")[i]), F.lit(0)) for i in range(40))).first()
    n, v = sums[0], sums[1]
    least = 1 << next(i for i in range(40) if sums[2 + i] <= head_words)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                h, c = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([h[c >= least].tobytes()]), pa.array([c[c >= least].tobytes()])], ["hashes", "counts"])

    words_only = counted.where(f"kind = {WORD}")
    got = words_only.select("hashes", "counts").mapInArrow(head, "hashes binary, counts binary").toArrow()
    h = np.frombuffer(b"".join(got["hashes"].to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(got["counts"].to_pylist()), np.int64)
    order = np.argsort(h)

    def rare_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, h, c in zip(batch.column("segment"), batch.column("hashes"), batch.column("counts"), strict=True):
                h, c = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)
                if (c < least).any():  # head words are held exactly
                    bits = build_segment(h[c < least], c[c < least]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([WORD], pa.int32()), pa.array([segment.as_py()], pa.int32()), pa.array([bits], pa.binary())], ["kind", "segment", "bits"])

    rare = materialize(words_only.select("segment", "hashes", "counts").mapInArrow(rare_bits, "kind int, segment int, bits binary"), "language-rare")
    filters = counted.where(f"kind = {PAIR}").select("kind", "segment", "bits").unionByName(rare)
    held: dict[int, LogFrequencyFilter | None] = {WORD: None, PAIR: None}
    if 8 * filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] <= broadcast_bits:
        for kind in held:
            table = filters.where(f"kind = {kind}").select("segment", "bits").toArrow()
            held[kind] = LogFrequencyFilter(table, shift)
            del table
    model = Model(n, v, h[order], c[order], held[PAIR], held[WORD])
    return model, words_only.select("hashes", "counts"), least, filters, shift


def _joined(documents: DataFrame, sent, filters: DataFrame, shift: int, scored, schema: str) -> DataFrame:
    """``scored`` of chunks of documents, with the levels that the segments of the filters gave back."""
    kind_of_id = documents.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            offsets = column_bytes(batch.column("text"))[1]
            for a, b in pieces(offsets):
                if size >= CHUNK:
                    chunk, place, size = chunk + 1, 0, 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, chunk)), pa.array(np.arange(place, place + b - a)), *(batch.column(c).slice(a, b - a) for c in ("doc_id", "text"))], ["chunk", "place", "doc_id", "text"])
                place, size = place + b - a, size + int(offsets[b] - offsets[a])

    def wanted(m: Model, texts: pa.Array) -> dict[int, list[np.ndarray]]:
        """Sorted, distinct n-grams that texts ask for, by pieces."""
        raw, offsets = column_bytes(texts)
        held: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        for a, b in pieces(offsets):
            token, row = token_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            word = np.unique(token)
            held[WORD].append(word[~m.in_head(word)[0]])
            held[PAIR].append(np.unique(pairs_of(before(token, row), token)))
        return held

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where reading parts a chunk, its runs of rows ask for themselves; ``first`` tells them apart.
        m = sent.value
        held: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        own = first = upto = -1

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                parts.clear()
                has, cut = by_segment(h, shift)
                if len(has):
                    ends = np.array([x for x, _ in cut] + [len(h)], np.int32) * 8
                    blobs = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(h)])
                    fixed = [pa.array(np.full(len(has), x)) for x in (own, first, upto)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(has), kind, np.int32)), pa.array(has), blobs], ["chunk", "first", "upto", "kind", "segment", "hashes"])

        for batch in released(batches):
            chunk, place = batch.column("chunk").to_numpy(), batch.column("place").to_numpy()
            cuts = np.r_[0, np.flatnonzero((chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1] + 1)) + 1, len(chunk)] if len(chunk) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (chunk[lo], place[lo]) != (own, upto):
                    yield from flush()
                    own, first = int(chunk[lo]), int(place[lo])
                upto = int(place[hi - 1]) + 1
                for kind, parts in wanted(m, batch.column("text").slice(lo, hi - lo)).items():
                    held[kind] += parts
        yield from flush()

    def answer(key, asked: pa.Table, bits: pa.Table) -> pa.Table:
        blobs = asked["hashes"].to_pylist()
        h = np.frombuffer(b"".join(blobs), np.uint64)
        blob = bits["bits"].to_pylist()
        level = probe_segment(blob[0] if blob else None, h).tobytes()
        ends = np.cumsum([len(x) // 8 for x in blobs]).tolist()
        out = asked.drop_columns(["hashes"])
        return out.append_column("levels", pa.array([level[e - len(x) // 8 : e] for x, e in zip(blobs, ends, strict=True)], pa.binary()))

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("place").combine_chunks()
        place, out = docs["place"].to_numpy(), []
        # In order of segments the answers are in order of the n-grams asked for.
        answers = answers.sort_by([("first", "ascending"), ("kind", "ascending"), ("segment", "ascending")])
        begin, kind, end = (answers[c].to_numpy() for c in ("first", "kind", "upto"))
        for lo in np.unique(begin):
            a, b = np.searchsorted(place, [lo, end[begin == lo][0]])
            own, held = docs.slice(a, b - a), {}
            for k, parts in wanted(sent.value, own["text"]).items():
                levels = b"".join(answers["levels"].filter(pa.array((kind == k) & (begin == lo))).to_pylist())
                held[k] = Levels(np.unique(np.concatenate(parts)), np.frombuffer(levels, np.uint8))
            m = replace(sent.value, pairs=held[PAIR], words=held[WORD])
            out += [x for batch in own.to_batches() for x in scored(m, batch)]
        return pa.Table.from_batches(out)

    chunks = materialize(documents.select("doc_id", "text").mapInArrow(number, f"chunk long, place long, doc_id {kind_of_id}, text string"), "language-chunks")
    asked = chunks.mapInArrow(ask, "chunk long, first long, upto long, kind int, segment int, hashes binary")
    answers = asked.groupBy("kind", "segment").cogroup(filters.groupBy("kind", "segment")).applyInArrow(answer, "chunk long, first long, upto long, kind int, segment int, levels binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def score(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    model, counted, least, filters, shift = train(documents, **options)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    n, v = model.n, model.v
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(m: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = column_bytes(batch.column("text"))
        for a, b in pieces(offsets):
            token, row = token_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            k = b - a
            count, exact = m.count(token)
            prev = before(token, row)
            prev_count = np.empty_like(count)
            prev_count[1:] = count[:-1]
            prev_count[prev == START] = m.starts
            logs = m.log10(token, prev, count, prev_count)
            tail = np.flatnonzero(~exact)
            cut = np.searchsorted(tail, np.r_[0, np.cumsum(np.bincount(row, minlength=k))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, k),
                    pa.array(np.bincount(row, minlength=k), pa.int64()),
                    pa.array(np.bincount(row, exact & (count > 0), minlength=k).astype(np.int64)),
                    pa.array(np.bincount(row, np.where(exact, np.log10(count + 1), 0.0), minlength=k)),
                    pa.array(np.bincount(row, logs, minlength=k)),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(token[tail].view(np.int64))),
                ],
                ["doc_id", "n_tokens", "head_known", "head_log", "score", "tail"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield from scored(sent.value, batch)

    schema = f"doc_id {kind}, n_tokens long, head_known long, head_log double, score double, tail array<long>"
    if model.pairs is None:
        rows = _joined(documents, sent, filters, shift, scored, schema)
    else:
        rows = documents.select("doc_id", "text").mapInArrow(run, schema)
    rows = materialize(rows.withColumn("row", F.xxhash64("doc_id", "n_tokens", "score", "tail")), "language-rows")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                h, c = np.frombuffer(h.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[c < least]), pa.array(c[c < least])], ["token", "count"])

    result = rows.drop("tail")
    if least > 1:
        # Rows that are alike have alike tails, so one of them stands for all.
        tails = rows.dropDuplicates(["row"]).select("row", F.explode("tail").alias("token"))
        found = tails.join(counted.mapInArrow(rare, "token long, count long"), "token")
        added = found.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("count") + 1)).alias("tail_log"))
        result = result.join(added, "row", "left")
    else:
        result = result.withColumns({"tail_known": F.lit(0), "tail_log": F.lit(0.0)})
    return result.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score",
    )
