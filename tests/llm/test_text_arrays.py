import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm.textarrays import column_bytes, pieces, shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x1c\x85", max_size=30)), max_size=6))
def test_words_and_shingles_follow_their_definition(texts):
    raw, offsets = column_bytes(pa.array(texts, pa.string()))
    h, row, _, _ = words(raw, offsets)
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert row.tolist() == [i for i, w in enumerate(want) for _ in w]
    ids = {}
    for x, w in zip(h.tolist(), [w for ws in want for w in ws], strict=True):
        assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)
    s, r = shingles(h, row, len(texts), 3)
    seqs = [[tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [] for w in want]
    assert r.tolist() == [i for i, q in enumerate(seqs) for _ in q]
    seen = {}
    for x, q in zip(s.tolist(), [q for qs in seqs for q in qs], strict=True):
        assert seen.setdefault(q, x) == x
    assert len(set(seen.values())) == len(seen)


def test_pieces_cover_all_rows_and_slices_read_right():
    offsets = np.array([0, 5, 5, 100, 101, 103])
    assert [r for a, b in pieces(offsets, 6) for r in range(a, b)] == [0, 1, 2, 3, 4]
    raw, offs = column_bytes(pa.array(["x", "ab c", None, "d"], pa.string()).slice(1))
    assert bytes(raw) == b"ab cd" and offs.tolist() == [0, 4, 4, 5]
