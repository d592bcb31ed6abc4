import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rookery.llm.language_model import K0, K1, LogFrequencyFilter, build_segment, levels, middle, packed_counts, probe_segment, score, train, unpacked_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    tokens = {i: [*WORD.findall((t or "").lower()), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update(tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("head", [1 << 20, 40, 3])
def test_counts_and_base_are_exact_with_any_head(spark, head):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 900)) for i in range(120)] + [(500, None), (501, ""), (502, "same"), (503, "same")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    want = expected(rows)
    got = score(docs, head_words=head).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0


def test_model_knows_pairs_better_than_the_base(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog again") for i in range(40)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.score > r.base_score for r in got if r.held_out)


def test_filter_gives_back_levels():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2))
    count = rng.zipf(1.6, len(h)).clip(1, 10**6)
    shift = 4
    seg = h >> np.uint64(60)
    whole = LogFrequencyFilter(pa.table({"segment": list(range(16)), "bits": pa.array([build_segment(h[seg == s], count[seg == s]).tobytes() for s in range(16)], pa.binary())}), shift)
    found = whole.level(h)
    assert (found >= levels(count)).all() and (found == levels(count)).mean() > 0.97
    assert (whole.level(rng.integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.03
    one = np.flatnonzero(seg == 3)
    assert (probe_segment(build_segment(h[one], count[one]).tobytes(), h[one]) == found[one]).all() and not probe_segment(None, h[one]).any()
    mid = middle(levels(count))
    assert (np.abs(mid / count - 1) < 0.5).all()


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_scores_are_the_same_where_filters_are_joined(spark, head):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 900)) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in score(docs, head_words=head).collect()}
    joined = {r.doc_id: r for r in score(docs, head_words=head, broadcast_bits=0).collect()}
    assert joined == whole and len(whole) == len(rows)


def test_chunks_that_batches_part_keep_their_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 900)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    whole = {r.doc_id: r for r in score(docs).collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        joined = {r.doc_id: r for r in score(docs, head_words=40, broadcast_bits=0).collect()}
        assert {i: r.n_known for i, r in joined.items()} == {i: r.n_known for i, r in whole.items()}
        spark.conf.set(key, before)
        assert joined == {r.doc_id: r for r in score(docs, head_words=40).collect()}
    finally:
        spark.conf.set(key, before)


def test_head_words_take_no_place_in_the_filter(spark):
    model = train(spark.createDataFrame([(i, "a b c d") for i in range(20)], "doc_id long, text string"))[0]
    assert len(model.head) == 5 and not model.words.bits.any()


def test_empty_table_and_no_training_rows(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


def test_score_follows_its_formula(spark):
    """The same sum in plain Python from exact counts, quantised; only a false hit of the filter may differ."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 40)) % 300)) for i in range(300)]
    token = {i: ["<s>", *WORD.findall(t), "</s>"] for i, t in rows}
    single, both = Counter(), Counter()
    for i, t in token.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            single.update(t)
            both.update(zip(t, t[1:]))
    n, v = sum(single.values()) - single["<s>"], len(single) - 1

    def log10(a, b):
        c = single[a]
        k = K0 * max(c, 1) ** K1
        pair = min(float(middle(levels(np.array([both[a, b]])))[0]), c) if both[a, b] else 0.0
        return math.log10((pair + k * (single[b] + 1) / (n + v + 1)) / (c + k))

    want = {i: sum(log10(a, b) for a, b in zip(t, t[1:])) for i, t in token.items()}
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = np.array([abs(got[i] - want[i]) / -want[i] for i in want])
    assert off.max() < 0.2 and np.median(off) < 0.01, (off.max(), np.median(off))


def test_counts_are_packed_whole():
    n = np.array([1, 254, 255, 256, 3, 2**33])
    assert unpacked_counts(packed_counts(n), len(n)).tolist() == n.tolist() and len(packed_counts(n)) == 6 + 24


def test_segments_of_any_number(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 500, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({r.doc_id: r.base_score for r in score(docs, per_segment=p, head_words=8).collect()} for p in (1 << 18, 64))
    assert few == pytest.approx(many)
