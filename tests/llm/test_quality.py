import zlib

import numpy as np
import pyarrow as pa

from rookery.llm.quality import WIDTH, _chosen, features, keep_good, score, train


def rows():
    rng = np.random.default_rng(1)
    words = ["stone", "river", "and", "the", "of", "green", "walks", "slowly", "house", "under"]
    out, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, rng.integers(5, 60)))
        bad = i % 6 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 12 else text.replace(" ", "### ")
        out.append((i, text, "x"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return out, labels


def test_held_out_accuracy_and_kept_columns(spark):
    docs_, labels_ = rows()
    docs = spark.createDataFrame([*docs_, (1000, None, "x"), (1001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*labels_, (5000, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    truth = {i: int(i % 6 != 0) for i, _, _ in docs_}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_without_labels_nothing_is_rejected_and_with_zeros_only_everything(spark):
    docs = spark.createDataFrame([(1, "A!! B!!"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in score(docs, train(docs, labels.limit(0))).collect()] == [1.0, 1.0]
    assert all(r.score < 1e-9 and r.predicted == 0 for r in score(docs, train(docs, labels)).collect())
    assert score(docs.limit(0), None).collect() == []


def test_samples_are_not_empty_at_any_size(spark):
    """Also where the share is below one in 2**20: of 16e9 rows 8e6 hold about six of a sample of 12,000."""
    ids = spark.range(50_000).withColumnRenamed("id", "doc_id")
    assert 300 < ids.where(_chosen("x", 500, 50_000)).count() < 700
    assert ids.where(_chosen("x", 12_000, 10**14)).count() == 0
    assert 0 < spark.range(8_000_000).withColumnRenamed("id", "doc_id").where(_chosen("x", 12_000, 16 * 10**9)).count() < 25


def test_features_follow_whole_texts_and_not_their_neighbours():
    a = features(pa.array(["ab AB", None, "", "x" * 5_000_000, "ab AB"]))
    assert a.shape == (5, WIDTH) and (a[0] == a[4]).all() and not a[1].any() and not a[2].any()
    assert np.allclose((a[:, :-1] ** 2).sum(1), [1, 0, 0, 1, 1], atol=1e-5)


def test_held_out_accuracy_on_the_tables(spark):
    """The query as it is registered, on labels that it may not learn from."""
    from rookery.llm.queries import op8_quality_classifier

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
