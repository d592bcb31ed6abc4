import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from rookery.llm import decontaminate
from rookery.llm.decontaminate import BITS, BLOCKS, RADIUS, Benchmark, fingerprints, keep_clean, leaks, matches, near, plain_words, vectors
from rookery.llm.textarrays import column_bytes

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def low(t):
    return [w.lower() for w in WORD.findall(t or "")]


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = low(t)
        for i, b in items:
            x = low(b)
            if not x or len(w) < min(5, len(x)):
                continue
            n = min(len(x), len(w))
            own = Counter(grams(x))
            best = 0
            for a in range(len(w) - n + 1):
                c = Counter(grams(w[a : a + n]))
                best = max(best, sum((c & own).values()) / sum((c | own).values()))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_same_leaks_as_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    items = [(i, say(rng.choice([3, 6, 20, 40, 40, 80]))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = [(0, None), (1, ""), (2, "w1"), (3, " ".join(["w1"] * 30))]
    for d in range(10, 90):
        text = say(rng.randint(1, 150))
        if d % 2:
            passage = rng.choice(items)[1] or ""
            w = passage.split()
            if w and d % 4 == 3:
                w[rng.randrange(len(w))] = "CHANGED"
            text = f"{text} {'!! '.join(w).upper() if d % 3 == 0 else ' '.join(w)} {say(rng.randint(0, 60))}"
        docs.append((d, text))
    docs.append((95, " ".join(items[5][1].split()[:-1])))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(d, b).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    grouped = {(r.doc_id, r.item_id) for r in leaks(d, b, max_items=4).collect()}
    assert grouped == set(want)
    clean = keep_clean(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {k[0] for k in want}


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 256, (8, BITS // 8), dtype=np.uint8)
    prints = np.repeat(items, 50, axis=0)
    for i, p in enumerate(prints):
        for bit in rng.choice(BITS, i % (RADIUS + 6), replace=False):
            p[bit // 8] ^= 1 << (bit % 8)
    for one in items:
        assert (near(prints, one[None]) == (np.bitwise_count(prints ^ one).sum(1) <= RADIUS)).all()
    assert BITS % BLOCKS == 0


def test_few_items_are_looked_at(monkeypatch):
    """Of 3,000 items that share a phrase, windows meet few; and set-up takes linear time."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, f"what is the best answer to this question {say(40)}") for i in range(3000)]
    start = time.time()
    bench = Benchmark(items)
    texts = [f"{say(300)} what is the best answer to this question {say(200)}" for _ in range(20)] + [f"{say(30)} {items[7][1]} {say(30)}"]
    looked = []
    monkeypatch.setattr(decontaminate, "near", lambda a, b: looked.append(len(a)) or near(a, b))
    found = [matches(plain_words(*column_bytes(pa.array([t])))[0], bench, 0.8) for t in texts]
    assert [m[0] for m in found[-1]] == [7] and not any(found[:-1])
    assert sum(looked) < 0.001 * 3000 * sum(len(t.split()) for t in texts) and time.time() - start < 20


def test_very_long_text_and_item():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 300_000))
    item = " ".join(text.split()[100_000:120_000])
    bench = Benchmark([(None, item), (5, "w1 w2 w3 nowhere here at all")])
    assert bench.ids == [None, 5]
    assert matches(plain_words(*column_bytes(pa.array([text])))[0], bench, 0.8) == [(0, 100_000, 20_000, 1.0)]


def test_items_without_id_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", "x", 3), (None, "a b c d e f g", "y", 4), (2, "other words are here now", "z", 5)], "doc_id long, text string, item_id string, at int")
    b = spark.createDataFrame([(None, "a b c d e f g", 1.0)], "item_id long, text string, similarity double")
    assert [(r.doc_id, r.item_id, r.similarity) for r in leaks(d, b).orderBy("doc_id").collect()] == [(None, None, 1.0), (1, None, 1.0)]
    assert [tuple(r) for r in keep_clean(d, b).collect()] == [(2, "other words are here now", "z", 5)]


def test_simhash_distance_follows_similarity():
    rng = np.random.default_rng(3)
    for _ in range(200):
        bag = rng.integers(0, 2**63, 45, dtype=np.uint64)
        other = np.concatenate([bag[:40], rng.integers(0, 2**63, 5, dtype=np.uint64)])  # similarity 0.8
        a, b = (fingerprints(vectors(x).sum(0, dtype=np.int32)) for x in (bag, other))
        assert np.bitwise_count(a ^ b).sum() <= RADIUS


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, b).collect() == [] and leaks(d.limit(0), d.selectExpr("doc_id as item_id", "text")).collect() == []
    assert keep_clean(d, b).count() == 1
