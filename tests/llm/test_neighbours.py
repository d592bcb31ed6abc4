import numpy as np
import pytest

from rookery.llm.neighbours import index, nearest, search


def brute(rows, q, k):
    by = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(q[1], np.float32).astype(float)) ** 2).sum())), i) for i, v in rows if len(v) == len(q[1])]
    return sorted((d, i) for d, i in by if i != q[0])[:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=24) * 0.6).astype(np.float32)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    graphs, shards, cells = index(df, cell_rows=200, shard_rows=100)
    assert len(cells[24][0]) == 8 and cells[24][1] < 8 and graphs.count() > 12
    got = {}
    for r in search(graphs, shards, cells, df.where("vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hit = 0
    for i, v in rows[::25]:
        want = brute(rows, (i, v), 10)
        own = sorted(got[i])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, x) for _, s, x in own] == sorted((s, x) for _, s, x in own)
        at = {x: d for d, x in brute(rows, (i, v), len(rows))}
        assert all(abs(s - at[x]) < 1e-9 for _, s, x in own)
        hit += len({x for _, _, x in own} & {x for _, x in want})
    assert hit / (10 * len(rows[::25])) >= 0.95


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [nan, 1.0]), (904, [inf, 1.0]), (905, [None, 1.0])]
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(100, [1.0, 2.5]), (200, [3.0, 4.0, 5.0]), (300, [3.0, 4.0, 6.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in odd + rows], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in nearest(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert set(got) == {i for i, _ in rows}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[30] == [(i, 0.0) for i in range(10)] and got[5] == [(i, 0.0) for i in range(11) if i != 5]
    assert got[100] == [(i, 0.5) for i in range(10)]
    assert got[200] == [(300, 1.0)] and got[300] == [(200, 1.0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, df).collect() == []


@pytest.mark.parametrize("n, spread", [(400, 1.0), (3000, 1.0), (3000, 0.1)])
def test_recall_at_several_sizes_and_without_clusters(spark, n, spread):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, 16)) * spread + rng.normal(size=(5, 16))[rng.integers(0, 5, n)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), cell_rows=300, shard_rows=600).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[i] & set(np.argsort(((x - x[i]) ** 2).sum(1) + np.where(np.arange(n) == i, np.inf, 0))[:10].tolist())) for i in range(0, n, 50))
    assert hit / (10 * len(got)) >= 0.93


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-12, 2.0]) for i in range(40)] + [(100, [1e300, 1.0]), (101, [1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, df.where("vec_id in (0, 100)")).collect()}
    assert [got[0, r][0] for r in range(1, 11)] == list(range(1, 11)) and got[0, 1][1] == rows[1][1][0] - 1.0
    assert got[100, 1] == (101, 1.0)


def test_rows_of_equal_and_null_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df).collect())
    one = [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 1, 1.0)]
    assert got == sorted([*one, *one, (1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 1, 0.0), (2, 2, 1, 0.0), (2, 3, 1, 1.0)])
