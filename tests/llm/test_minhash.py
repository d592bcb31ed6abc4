import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rookery.llm.minhash import _links, _sketch, components, keep_one, merged, near_duplicates, signatures
from rookery.llm.textarrays import column_bytes, exact

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute(rows, k):
    s = sets(rows, k)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 9999)}"
        yield " ".join(own)


@pytest.mark.parametrize("k", [4, 5])
def test_same_components_as_brute_force(spark, k):
    rng = random.Random(k)
    texts = [None, "", " \t", "one", "One", "one two", "a b c d", "a b c d"]
    for _ in range(6):
        texts += family(rng, 12, rng.choice([8, 30, 120]), 4)
    texts += ["same text for all of these rows here"] * 40
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, component_id int")
    want = brute(rows, k)
    for r in near_duplicates(docs, k=k).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    kept = keep_one(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][1] == i)


def test_members_unlike_the_hub_still_find_each_other(spark):
    """A chain: neighbours are alike, ends are not."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
    want = brute(rows, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {i: c for i, (_, c) in want.items()}


def test_links_deep_in_large_buckets_are_found(spark):
    """Many texts share most of a passage and are no links; a few hidden pairs among them are."""
    base = [f"w{i}" for i in range(112)]
    rows = [(2 * i + j, " ".join([*base, f"o{i}", *(f"e{i}_{j}_{x}" for x in range(14))])) for i in range(100) for j in range(2)]
    want = brute(rows, 1)
    assert sum(c != i for i, (_, c) in want.items()) == 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, k=1).collect()} == {i: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("shared, more", [(4, (0, 1)), (8, (0, 2)), (8, (1, 1)), (16, (2, 2)), (240, (30, 30))])
def test_sketch_bits_are_independent(shared, more):
    """Pairs at the threshold, of any size, agree in enough bits."""
    rng = np.random.default_rng(3)
    n = 500
    sketches = []
    both = rng.integers(0, 2**64, (n, shared), dtype=np.uint64)
    for extra in more:
        s = np.sort(np.hstack([both, rng.integers(0, 2**64, (n, extra), dtype=np.uint64)]), axis=1)
        sketches.append(_sketch(signatures(np.repeat(np.arange(n), s.shape[1]), s.ravel(), n)))
    assert (np.bitwise_count(sketches[0] ^ sketches[1]).sum(1) <= 256 - 208).all()


def test_components(spark):
    edges = [(9, 4), (4, 7), (7, 1), (20, 21), (22, 21), (5, 5), *((100 + i, 101 + i) for i in range(30))]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 1, 4: 1, 7: 1, 21: 20, 22: 20, **{101 + i: 100 for i in range(30)}} or {k: v for k, v in got.items() if k != v} == {9: 1, 4: 1, 7: 1, 21: 20, 22: 20, **{101 + i: 100 for i in range(30)}}


def test_components_grow_by_new_edges(spark):
    rng = random.Random(4)
    every = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    df = lambda e: spark.createDataFrame(e, "a long, b long")
    known = components(df(every[:40]))
    for part in (every[40:80], every[80:]):
        known = merged(known, df(part))
    whole = {r.id: r.component for r in components(df(every)).collect()}
    assert {r.id: r.component for r in known.collect()} == whole and known.count() == len(whole)


def test_rows_of_null_doc_id_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False)]
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(docs).collect()) == [(0, "a b c d"), (0, "x y z"), (1, "a b c d")]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_built_to_collide_are_no_link(spark):
    """The Thue-Morse word and its complement: equal under any hash linear in the bytes."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([("x", word), ("y", other), ("z", word.upper())], "doc_id string, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs).collect()} == {"x": ("x", True), "y": ("y", True), "z": ("x", False)}


def test_links_are_right_even_if_hashes_collide(monkeypatch):
    a = pa.array(["One two THREE four five", "a b c d", "", "x y"])
    b = pa.array(["one two three four five", "a b c e", "", "x y"])
    want = [True, False, False, True]
    assert _links(a, b, 4, 80).tolist() == want
    monkeypatch.setattr("rookery.llm.minhash.exact", lambda *_: False)
    assert _links(a, b, 4, 80).tolist() == want


def test_exact_sees_colliding_words(monkeypatch):
    raw, offsets = column_bytes(pa.array(["one two three four five", "one two three four six"]))
    assert exact(raw, offsets, 4)
    monkeypatch.setattr("rookery.llm.textarrays._PLACED", np.ones(32 * 256, np.uint64))
    assert not exact(raw, offsets, 4)


def test_recall_over_thousands_of_links(spark):
    """Families of many shapes: no link that brute force knows is lost, none is made up."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        texts += family(rng, rng.randint(2, 24), rng.choice([9, 20, 60, 150]), rng.choice([1, 3, 6]))
    rows = list(enumerate(texts))
    s = sets(rows, 4)
    links = sum(100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) for a in s for b in range(a + 1, len(s)))
    assert links > 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {i: c for i, (_, c) in brute(rows, 4).items()}
