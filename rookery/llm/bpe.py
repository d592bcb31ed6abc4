"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its inverse.

Encoding one stretch of bytes walks left to right, taking the longest token
that may follow its predecessor and backing off where none does; two tokens may
stand side by side exactly if merging them again would reproduce them.  A token
is *stable*, so emitted, once ``lookahead`` more bytes are known: a change at
the right end moves left only along merges of rising rank that contend for a
symbol, and the longest such chain in the merge list bounds its reach.  The
window that is kept is a few lookaheads long, whatever the text's length; at an
emitted boundary the rest is encoded on its own, as the encoding of a suffix
that starts at a boundary is the suffix of the encoding.

Word-like stretches come from the byte-level splitting pattern, applied to
slices of about 64K characters cut where a stretch ends anyway (before white
space that follows something else).  Their encodings are remembered in a table
of bounded size.

Decoding is an incremental state machine from ids to bytes to text; bytes that
are no UTF-8 become U+FFFD.

Cases: null and empty texts give no ids.  A special token's string in a text is
that token.  Repeated rows each keep theirs; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rookery.llm.textarrays import bounded, released

# Fixed value: the splitting pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1 << 16
#: Entries of a generation of remembered stretches and of remembered pairs of tokens; two are held.
MEMO, BESIDE = 1 << 16, 1 << 16
NONE = -1
SHORT = (3, 2)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which no later byte can change a token.

    Whether merge k happens matters to a merge further left only if that one
    has a later rank and its right part is what k takes (its left part) or
    makes.  The reach of such a chain is at most the sum of its lengths.
    """
    reach: dict[bytes, int] = {}
    most = 1
    for left, right in merges:
        here = len(left) + len(right) + reach.get(right, 0)
        most = max(most, here)
        for symbol in (left, left + right):
            if reach.get(symbol, 0) < here:
                reach[symbol] = here
    return most


class Transducer:
    """Tables of one merge list.  Inner ids are 0-255 for bytes, then 256 + rank."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.lookahead = sufficient_lookahead(merges)

        self.bytes = [bytes([b]) for b in range(256)]
        inner = {b: i for i, b in enumerate(self.bytes)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            i = len(self.bytes)
            self.bytes.append(a + b)
            self.parts.append((inner[a], inner[b]))
            self.pair[inner[a], inner[b]] = i
            inner.setdefault(a + b, i)
        self.inner = inner
        self.out = [pack("<I", vocab[b]) for b in self.bytes]
        self.length = [len(b) for b in self.bytes]
        # What lengths tokens of four bytes or more have, by their first four, longest first; any start may have a token of 3 or 2.
        sizes: dict[bytes, set[int]] = {}
        for b in self.bytes:
            if len(b) >= 4:
                sizes.setdefault(b[:4], set()).add(len(b))
        self.sizes = {b: (*sorted(own, reverse=True), *SHORT) for b, own in sizes.items()}
        self.shorter = [next((inner[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in inner), NONE) for b in self.bytes]
        self.beside: dict[int, bool] = {}
        self.beside_before: dict[int, bool] = {}
        self.window = max(4096, 4 * self.lookahead)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.text_of[i] = b
        for s, i in self.special.items():
            self.text_of[i] = s.encode()
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.memo = _Memo(self)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``a b`` merges to ``a b`` again."""
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            known = self.beside_before.get(key)
            if known is None:
                known = self._undisturbed(a, b)
            if len(self.beside) >= BESIDE:
                self.beside, self.beside_before = {}, self.beside
            self.beside[key] = known
        return known

    def forget(self) -> None:
        """Empties the tables of what was seen; the worker may have other work to do."""
        self.memo.clear()
        self.memo.before = {}
        self.beside, self.beside_before = {}, {}

    def _undisturbed(self, a: int, b: int) -> bool:
        """Undo the later of the two seam symbols' merges, again and again; no earlier merge may span the seam."""
        pair, parts, limit = self.pair, self.parts, len(self.bytes)
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            right_first = a > b
            if right_first and parts[a] is None or not right_first and parts[b] is None:
                right_first = not right_first
                if parts[a if right_first else b] is None:
                    return True
            if right_first:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def tokens(self, data: bytes) -> list[int]:
        """The encoding of one stretch, all of it."""
        inner = self.inner
        whole = inner.get(data)
        if whole is not None and self._alone(whole):
            return [whole]
        out: list[int] = []
        length, shorter, follow, sizes, beside = self.length, self.shorter, self.may_follow, self.sizes, self.beside
        dead: set[int] = set()
        at, size, last = 0, len(data), NONE
        while at < size:
            # The longest token from here; a slice that the end cuts short is all that is left.
            for k in sizes.get(data[at : at + 4], SHORT):
                token = inner.get(data[at : at + k])
                if token is not None:
                    break
            else:
                token = data[at]
            while True:
                end = at + length[token]
                if end not in dead:
                    if last == NONE:
                        break
                    fits = beside.get(last << 32 | token)
                    if follow(last, token) if fits is None else fits:
                        break
                token = shorter[token]
                while token == NONE:  # none goes on from here: the one before must be shorter
                    dead.add(at)
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else NONE
                    token = shorter[token]
            out.append(token)
            last, at = token, end
        return out

    def _alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        parts = self.parts[token]
        return parts is None or self.may_follow(*parts) or self.pair.get(parts) == token

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of a stretch of any length, each as soon as it is stable."""
        at = 0
        while len(data) - at > self.window:
            known = at
            for token in self.tokens(data[at : at + self.window]):
                if known + self.length[token] > at + self.window - self.lookahead:
                    break
                known += self.length[token]
                yield token
            at = known
        yield from self.tokens(data[at:])

    def slices(self, text: str, at: int, end: int) -> Iterator[str]:
        while end - at > SLICE:
            m = self.cut.search(text, at + SLICE, end)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        if at < end:
            yield text[at:end]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a slice of the text at a time."""
        memo, split, at = self.memo, self.split.findall, 0
        for m in self.marks.finditer(text) if self.marks else ():
            for part in self.slices(text, at, m.start()):
                yield b"".join([memo[s] for s in split(part)])
            yield pack("<I", self.special[m.group()])
            at = m.end()
        for part in self.slices(text, at, len(text)):
            yield b"".join([memo[s] for s in split(part)])

    def decode(self, packed: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids; a character is given out once its last byte has come."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.text_of
        for p in packed:
            yield state.decode(b"".join([table[i] for i in np.frombuffer(p, "<u4").tolist()]))
        yield state.decode(b"", True)


class _Memo(dict):
    """Packed ids of stretches seen lately: this generation and the one before."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.before: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        packed = self.before.get(stretch)
        if packed is None:
            t = self.transducer
            data = stretch.encode()
            packed = b"".join(map(t.out.__getitem__, t.tokens(data) if len(data) <= t.window else t.stream(data)))
        if len(stretch) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[stretch] = packed
        return packed


@lru_cache(maxsize=1)
def transducer(source: str) -> Transducer:
    return Transducer(source)


def encode_documents(documents: DataFrame, tokenizer: str, *, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts; with ``ids`` also the ids.

    ``tokenizer`` is the path of a byte-level BPE file in JSON; the driver reads
    it and sends its text (a file of fixed size) to the workers.
    """
    source = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(source.value)
        for batch in released(batches):
            n, digests, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                there, back, kept, size = hashlib.sha256(), hashlib.sha256(), [], 0

                def noted(text=text, there=there, kept=kept) -> Iterator[bytes]:
                    nonlocal size
                    for p in t.encode(text.as_py() or ""):
                        there.update(p)
                        size += len(p) // 4
                        if ids:
                            kept.append(p)
                        yield p

                for s in t.decode(noted()):
                    back.update(s.encode())
                n.append(size)
                digests.append(there.hexdigest())
                decoded.append(back.hexdigest())
                if ids:
                    lists.append(np.frombuffer(b"".join(kept), "<i4"))
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)
        t.forget()

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return bounded(documents).select("doc_id", "text").mapInArrow(run, schema)
