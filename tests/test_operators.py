"""Hand-checked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.functions import similarity as S
from rookery.functions import text as T
from rookery.operators import assign, blocking, diagnostics, evaluate, features, model, sampling, tfidf, windows
from rookery.operators.running import running
from rookery.plans import durable
from rookery.sources import records as R
from rookery.sources import sinks
from rookery.streaming.matching import candidate_rates, match_stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_normalization(spark):
    norm = lambda s: one(spark, T.normalize("s"), s=s)
    deva = "राम मार्केटिंग प्राइवेट लिमिटेड"
    assert norm(deva).split() == deva.split() and all(len(t) >= 3 for t in norm(deva).split())
    assert norm("") == "" and norm(norm("AT & T,  Inc.\x1cx")) == norm("AT & T,  Inc.\x1cx") == "at and t inc x"
    core = lambda s: one(spark, T.name_core(T.normalize("s")), s=s)
    assert core("Acme Foods Inc") == core("Foods Acme LLC") and core("The Inc") == "inc the"
    country = lambda s: one(spark, T.country_key("s"), s=s)
    assert country(" UNITED  states ") == country("United States")


def test_native_normal_form_equals_the_full_one_on_ascii(spark):
    df = spark.createDataFrame([("".join(map(chr, range(128))),), ("a\x1cb\x1fc d_e",), (None,)], "s string")
    assert all(r.a == r.b for r in df.select(T.normalize("s").alias("a"), T.normalize_native("s").alias("b")).collect())


def test_records_split_no_more_of_a_text_than_they_need(spark):
    texts = [None, "", "  ", " a  b ", "\t" + " ".join(f"w{i}" for i in range(13)), *(lead + " \n".join(f"w{i}" for i in range(n)) + tail for n in (14, 15, 16, 40) for lead in ("", " \x0b") for tail in ("", "  ")), *(" ".join(chr(97 + i) * n for i in range(20)) for n in (27, 31, 32, 33, 600)), " " * 500 + "a b"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 9}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    whole, got = docs.select("doc_id", T.raw_tokens(F.col("text")).alias("w")).collect(), {r.doc_id: r for r in R.records_view(docs).where("doc_id % 7 <> 3 OR source = 'S1'").collect()}
    assert all(got[r.doc_id].name == " ".join(r.w[:6]) and got[r.doc_id].address == " ".join(r.w[6:14]) for r in whole if r.doc_id in got)
    long = docs.limit(1).withColumn("text", F.lit("w " * 100))
    assert long.select(F.size(T.raw_tokens(F.col("text"), 14)).alias("n")).first().n == 14
    # No part of the plan splits without a limit.
    plan = R.records_view(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and ", -1)" not in plan


@pytest.mark.parametrize(("raw", "stem"), [("wilfordhancock.com", "wilfordhancock"), ("www.ram-trading.co.in", "ram trading"), ("Ram Trading Private Limited", ""), ("Shree Stores Co", ""), ("", ""), ("co.in", "")])
def test_domain_stem(spark, raw, stem):
    assert one(spark, T.domain_stem("s"), s=raw) == stem


def test_ratios():
    assert S.ratio("abcd", "abxd") == pytest.approx(0.75) and S.ratio("", "") == 1.0 and S.ratio("a", "") == 0.0
    assert S.token_sort_ratio("b a", "a b") == 1.0
    assert S.token_set_ratio("acme foods", "acme foods north") == 1.0 and S.token_set_ratio("", "a") == 0.0
    assert S.lcs("kitten", "sitting") == 4


def test_pair_features(spark):
    recs = spark.createDataFrame(
        [("S1-1", "S1", "US", "Wilford Hancock", "1 Elm St"), ("S2-1", "S2", "US", "wilfordhancock.com", "2 Elm St"), ("S1-2", "S1", "IN", "Ram Trading Private Limited", ""), ("S3-2", "S3", "IN", "राम ट्रेडिंग प्राइवेट लिमिटेड", "")],
        "entity_id string, source string, country string, name string, address string",
    )
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-2", "S3-2", 0.5), ("S1-1", "unknown", 0.1)], "s1_id string, cand_id string, score double")
    a, b = features.featurize(pairs, recs).orderBy("s1_id").collect()
    assert a.is_domain_r == 1 and a.eff_name_ratio > 0.9 and a.cand_is_S2 == 1 and a.addr_first_num_conflict == 1
    assert b.translit_ratio > 0.5 and b.addr_contain_fwd is None and b.addr_dice is None and b.addr_last_exact == 0 and b.is_cross_script == 1 and b.name_digits_equal == 1


def test_group_features(spark):
    rows = [(0, 10, 0.97), (0, 11, 0.62), (0, 12, 0.55), (1, 13, 0.97), (1, 14, 0.96), (2, 10, 0.91)]
    df = spark.createDataFrame(rows, "s1_id int, cand_id int, score double")
    g = [windows.reciprocal_features(windows.group_features(df)).where((F.col("s1_id") == s) & (F.col("cand_id") == c)).first() for s, c, _ in rows]
    assert g[0].score_margin_to_2nd == pytest.approx(0.35) and g[3].score_margin_to_2nd == pytest.approx(0.01) and g[5].score_margin_to_2nd is None
    assert g[0].n_competitors_for_cand == g[5].n_competitors_for_cand == 2 and g[0].is_mutual_best == 1 and g[5].is_mutual_best == 0
    assert g[5].z_score_in_group is None


@pytest.mark.parametrize(("pred", "truth", "score"), [("a", "ab", 0.8333333), ("abx", "ab", 0.7142857), ("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0), ("ax", "a", 0.5555556), ("ab", "abc", 0.9090909), ("abcx", "abc", 0.7894737), ("z", "ab", 0.0)])
def test_f05(spark, pred, truth, score):
    df = lambda s: spark.createDataFrame([("e", c) for c in s], "s1_id string, cand_id string")
    assert evaluate.macro_f05(df(pred), df(truth), spark.createDataFrame([("e",)], "s1_id string")).first().macro_f05 == pytest.approx(score, abs=1e-6)


def test_macro_counts_every_entity(spark):
    df = lambda r: spark.createDataFrame(r, "s1_id string, cand_id string")
    got = evaluate.macro_f05(df([("s1", "a")]), df([("s1", "a"), ("s2", "b")]), spark.createDataFrame([("s1",), ("s2",), ("s3",)], "s1_id string")).first()
    assert got.macro_f05 == pytest.approx(2 / 3)


def assigned(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.s1_id, set()).add(r.cand_id)
    return out


def test_assignment(spark):
    df = lambda r: spark.createDataFrame(r, "s1_id string, cand_id string, prob double")
    ab = df([("A", "X", 0.9), ("A", "Y", 0.7), ("B", "X", 0.6), ("B", "Z", 0.55)])
    assert assigned(assign.threshold_assign(ab)) == {"A": {"X", "Y"}, "B": {"Z"}}
    assert assigned(assign.threshold_assign(ab, resolve=False)) == {"A": {"X", "Y"}, "B": {"X", "Z"}}
    assert assigned(assign.threshold_assign(df([("C", "M", 0.45), ("C", "N", 0.1)]))) == {"C": {"M"}}
    assert assigned(assign.threshold_assign(df([("D", "M", 0.2), ("D", "N", 0.05)]))) == {}
    assert len(assigned(assign.threshold_assign(df([("E", c, 0.9) for c in "VWXYZ"]), max_k=2))["E"]) == 2
    assert assigned(assign.threshold_assign(df([("F", "Q", 0.8), ("G", "Q", 0.4)]), tau=0.9)) == {"F": {"Q"}}


@pytest.mark.parametrize(("p", "n"), [([0.98, 0.02, 0.01], 1), ([0.97, 0.95, 0.93, 0.02], 3), ([0.05, 0.03, 0.01], 0), ([0.6], 1), ([0.99, 0.99, 0.99, 0.6], 3), ([0.0], 0)])
def test_expected_f05_size(spark, p, n):
    assert one(spark, assign.expected_best_n(F.col("p"), 8), p=p) == n


def test_sweep_counts_entities_without_pairs(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.15)], "s1_id string, cand_id string, prob double")
    truth = spark.createDataFrame([("a", "x")], "s1_id string, cand_id string")
    all_ = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    got = {(r.tau, r.tau_single): r for r in assign.sweep(pairs, truth, all_, max_ks=(2,), resolve=(True,)).collect()}
    assert got[0.5, 0.2].macro_f05 == 1.0 and got[0.5, 0.1].macro_f05 == pytest.approx(0.666667) and got[0.5, 0.2].n_pred_empty == 2
    assert len(assign.grid(spark).collect()) == 600


def test_leak_scan(spark):
    df = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) < 15).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000.0).alias("u"))
    df = df.select("id", "y", (0.3 * F.col("y") + 0.7 * F.col("u")).alias("honest"), (F.col("y") + 0.01 * F.col("u")).alias("leaked"))
    report = diagnostics.feature_report(df, ["honest", "leaked"], "y", "id")
    assert [r.feature for r in diagnostics.leak_suspects(report).collect()] == ["leaked"]


def test_bucket_cap_drops_heavy_keys(spark):
    recs = spark.createDataFrame([("S1-0", "S1", "US", "acme", ""), *((f"S2-{i}", "S2", "US", "acme", "") for i in range(5))], "entity_id string, source string, country string, name string, address string")
    p = blocking.prepare(recs)
    assert blocking.key_candidates(p, blocking.BlockConfig(cap=4)).count() == 0 and blocking.key_candidates(p, blocking.BlockConfig(cap=5)).count() == 5


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("s"))
    assert sampling.uniform(df, "id", 50, seed=3).count() == 50
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", 100).groupBy("s").count().collect()}
    assert got == {0: 86, 1: 14}
    must = df.where("id < 10")
    assert sampling.capped_pool(df, must, "id", 50).count() == 50 and sampling.capped_pool(df, must, "id", 50, count_mandatory=False).count() == 60
    assert sampling.capped_pool(df, must, "id", 5).count() == 10


def test_shuffled_labels_keep_their_number(spark):
    df = spark.range(2000).select(F.col("id").alias("s1_id"), F.col("id").alias("cand_id"), (F.col("id") < 500).cast("int").alias("y"))
    got = model.shuffled_labels(df)
    assert got.count() == 2000 and got.where("y = 1").count() == 500 and got.where("y = 1 and s1_id < 500").count() < 250


def test_files(spark, tmp_path):
    recs = tmp_path / "source.tsv"
    recs.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" name\t\t US \nS2-9\tBroken\nS2-2\tX\tY\tus\n', encoding="utf-8")
    got = {r.entity_id: r for r in R.read_records(spark, str(recs)).collect()}
    assert got["S1-1"].business_name == '"Quoted" name' and got["S1-1"].business_address == "" and got["S1-1"].ck == "us" == got["S2-2"].ck and got["S2-2"].source == "S2"
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2,S3-3\nS1-2\t\n")
    assert {r.s1_id: r.matched for r in R.read_truth(spark, str(truth)).collect()} == {"S1-1": ["S2-2", "S3-3"], "S1-2": []}
    assert R.read_truth(spark, str(truth), keep_empty=False).count() == 1
    pairs = spark.createDataFrame([("S1-1", "S2-2", "S2", 0.5), ("S1-1", "S2-1", "S2", 0.5), ("S1-9", "S3-1", "S3", 0.1234567)], "s1_id string, cand_id string, source string, score double")
    out = str(tmp_path / "long")
    sinks.write_tsv(sinks.long_rows(pairs), out)
    back = R.read_long_pairs(spark, out)
    assert back.count() == 3 and back.where("s1_id = 'S1-9'").first().score == pytest.approx(0.123457)
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    assert {r.source1_entity_id: r.candidate_entity_ids for r in sinks.wide(pairs, need).collect()} == {"S1-1": "S2-1,S2-2", "S1-2": ""}
    assert [r.s1_id for r in sinks.extras(pairs, need).collect()] == ["S1-9"]
    sub = {r.s1_id: r for r in sinks.submission(pairs, spark.createDataFrame([("S1-1", "S3-7")], "s1_id string, cand_id string"), need).collect()}
    assert sub["S1-1"].candidates == ["S2-1", "S2-2", "S3-7"] and sub["S1-1"].results == ["S3-7"] and sub["S1-2"].results == []
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-4"), ("S1-1", ""), ("S1-8", "S3-99")], "source1_entity_id string, candidate_entity_ids string")
    known = spark.createDataFrame([("S2-1",), ("S1-4",)], "entity_id string")
    assert {r.rule: r.n for r in sinks.violations(bad, need, known).collect()} == {"missing entity": 1, "entity not required": 1, "entity repeated": 1, "id of another source": 1, "id repeated": 1, "unknown id": 1}


def test_stream(spark, tmp_path):
    from rookery.streaming.matching import match_stream

    schema = "entity_id string, source string, country string, name string, address string"
    targets = spark.createDataFrame([("S2-1", "S2", "US", "acme foods", "1 elm"), ("S3-1", "S3", "FR", "acme foods", "")], schema)
    spark.createDataFrame([("S1-1", "S1", "US", "Acme Foods Inc", "")], schema).write.parquet(str(tmp_path / "in"))
    found = []
    q = match_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), targets, lambda df, n: found.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.s1_id, r.cand_id) for r in found] == [("S1-1", "S2-1")]


def test_text_forms(spark):
    """Written-out cases: full normal form, script, romanised."""
    cases = [
        ("Straße №5 & Co", "strasse no5 and co", "LATIN", None), ("AT & T", "at and t", "LATIN", None), ("ＦＵＬＬ　Ｗｉｄｔｈ", "full width", "FULLWIDTH", None),
        ("राम मार्केटिंग प्राइवेट लिमिटेड", "राम मार्केटिंग प्राइवेट लिमिटेड", "DEVANAGARI", "raam maarketing praaivet limited"),
        ("-- Holloway Peak Inc Seafood", "holloway peak inc seafood", "LATIN", None), ("1795", "1795", "NONE", None), ("", "", "NONE", None),
    ]
    for raw, norm, script, latin in cases:
        assert (one(spark, T.normalize("s"), s=raw), one(spark, T.dominant_script("s"), s=raw), one(spark, T.transliterate("s"), s=raw)) == (norm, script, latin)
    assert one(spark, T.normalize_naive("s"), s="लिमिटेड") != "लिमिटेड" and one(spark, T.normalize_lower("s"), s="STRASSE & ß") == "strasse and ß"


def test_set_measures_where_a_set_is_empty(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"], "abcdx", "abcdy"), ([], ["b"], "", ""), (["a"], ["c"], None, "x")], "x array<string>, y array<string>, n string, m string")
    got = [tuple(r) for r in df.select(S.jaccard_or_zero(F.col("x"), F.col("y")), S.overlap(F.col("x"), F.col("y")), S.same_start(F.col("n"), F.col("m"))).collect()]
    assert got == [(0.5, 1.0, 1), (0.0, 0.0, 0), (0.0, 0.0, 0)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_equal_a_window(spark, by):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 50, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x int, place int, n int").repartition(8)
    got = {(r.g, r.place): r.n_upto for r in running(df, [F.desc("x"), F.asc("place")], ["n"], by).collect()}
    total, want = {}, {}
    for g, x, place, n in sorted(rows, key=lambda r: (-r[1], r[2])):
        k = g if by else 0
        total[k] = total.get(k, 0) + n
        want[g, place] = total[k]
    assert got == want


def test_search_equals_brute_force_with_long_lists(spark):
    """Also where the bound lets long lists go and where documents come in many blocks."""
    import numpy as np

    rng = np.random.default_rng(3)
    common = ["the", "and", "of"]
    texts = [[*common[: rng.integers(1, 4)], *(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(2, 9)) % 3000)] for _ in range(2600)]
    docs = spark.createDataFrame([(f"d{i:05}", "p" if i % 2 else "q", t) for i, t in enumerate(texts)], "id string, part string, terms array<string>")
    asked = spark.createDataFrame([(f"a{i}", p, texts[i * 31]) for i in range(40) for p in ("p", "q")], "id string, part string, terms array<string>")
    vocab = tfidf.vocabulary(docs)
    q, d = tfidf.weigh(asked, vocab), tfidf.weigh(docs, vocab)
    vectors = lambda df: {k: dict(v) for k, v in _grouped((((r.part, r.id), (r.term, r.w)) for r in df.collect())).items()}
    qs, ds = vectors(q), vectors(d)
    want = {}
    for (part, a), x in qs.items():
        scores = [(-round(sum(w * y.get(t, 0) for t, w in x.items()), 6), i) for (p, i), y in ds.items() if p == part]
        want[part, a] = sorted(s for s in scores if s[0] < 0)[:15]
    for options in ({}, {"block_docs": 300, "block_queries": 7, "blocks_a_task": 2}):
        got = _grouped(((r.part, r.q), (-r.score, r.d)) for r in tfidf.cosine_search(q, d, 15, **options).collect())
        assert {k: sorted(v) for k, v in got.items()} == want


def _grouped(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return out


def test_romanised_names_are_second_documents(spark):
    recs = spark.createDataFrame([("S1-1", "S1", "IN", "Ram Trading", "x"), ("S2-1", "S2", "IN", "राम ट्रेडिंग", "x"), ("S2-2", "S2", "IN", "raam other", "x"), ("S1-2", "S1", "IN", "राम ट्रेडिंग", "x"), ("S2-3", "S2", "IN", "trediing praam", "x")], "entity_id string, source string, country string, name string, address string")
    p = blocking.prepare(recs)
    hits = {(r.s1_id, r.cand_id): r["pass"] for r in blocking.tfidf_pass(p, "name", "P2").collect()}
    assert hits["S1-1", "S2-1"] == "P4" and hits["S1-1", "S2-2"] == "P2" and ("S1-2", "S2-1") not in hits  # no other target has its letters
    exact = {(r.s1_id, r.cand_id) for r in blocking.exact_core(p).collect()}
    assert exact == {("S1-2", "S2-1")}  # an S1 record is known by its own spelling only


def test_datasets_and_written_files(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "S2-1", 0.5, None, 1), ("S1-1", "S2-2", None, 1.0, 0)], "s1_id string, cand_id string, a double, b double, y int")
    made = sinks.write_dataset(df, f"{tmp_path}/set", ["a", "b"], {"cap": 400}, spark.createDataFrame([("x", 1.0)], "token string, idf double"))
    data, manifest = sinks.read_dataset(spark, f"{tmp_path}/set")
    assert manifest == made and manifest["columns"] == ["a", "b"] and sorted(map(tuple, data.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    data.where("y = 1").write.mode("overwrite").parquet(f"{tmp_path}/other")
    (tmp_path / "set" / "data").rename(tmp_path / "gone")
    (tmp_path / "other").rename(tmp_path / "set" / "data")
    with pytest.raises(ValueError, match="belong together"):
        sinks.read_dataset(spark, f"{tmp_path}/set")
    wide = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", ""), ("S1-3", "S1-9")], "source1_entity_id string, candidate_entity_ids string")
    sinks.write_tsv(wide.coalesce(1), f"{tmp_path}/wide")
    assert tuple(sinks.integrity(spark, f"{tmp_path}/wide").first()) == (True, 3, 1, 3, 1, 0)
    with open(next((tmp_path / "wide").glob("part-*")), "a", encoding="utf-8") as f:
        f.write("S1-4")
    (tmp_path / "wide" / "more.csv").write_text("S2-1\tS2-2\n", encoding="utf-8")
    for x in (tmp_path / "wide").glob(".*.crc"):
        x.unlink()
    assert tuple(sinks.integrity(spark, f"{tmp_path}/wide").first()) == (False, 5, 2, 4, 1, 2)


def test_required_ids_come_in_file_order(spark, tmp_path):
    ids = [f"S1-{(i * 7919) % 5000}" for i in range(5000)]
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tname {i} {'x' * 30}\tstreet\tUS\n" for i in ids), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = R.read_required_ids(spark, str(tmp_path / "s1.tsv"))
        assert df.rdd.getNumPartitions() > 3 and [r.s1_id for r in df.orderBy("place").collect()] == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunks_partitions_and_resuming(spark, tmp_path):
    pairs = spark.createDataFrame([(f"S1-{i % 20}", f"S2-{i}", i / 100) for i in range(100)], "s1_id string, cand_id string, score double")
    got = R.in_chunks(pairs, 20, 3).collect()
    assert len(got) == 60 and all(len(set(c)) == 1 for c in _grouped((r.s1_id, r.chunk) for r in got).values()) and 1 < len({r.chunk for r in got}) <= 3
    recs = spark.createDataFrame([(f"S1-{i}", "us" if i % 3 else "fr") for i in range(30)] + [("S1-x", "in")], "entity_id string, ck string")
    assert R.partition_order(R.country_counts(recs)) == ["us", "fr", "in"] and R.partition_order(R.country_counts(recs), "ascending") == ["in", "fr", "us"] and R.partition_order(R.country_counts(recs), "natural") == ["fr", "in", "us"]
    out, calls = str(tmp_path / "out"), []

    def work(df):
        calls.append(1)
        return df if len(calls) != 2 else df.select(F.raise_error(F.lit("broken off")).alias("x"))

    with pytest.raises(Exception, match="broken off"):
        R.resume(recs, out, work)
    assert R.pending(recs, out) == ["in", "us"] and R.resume(recs, out, work) == ["in", "us"] and R.resume(recs, out, work) == []
    assert spark.read.parquet(out).count() == 31
    R.write_partitioned(recs, str(tmp_path / "by"), 4)
    assert spark.read.parquet(str(tmp_path / "by")).where("ck = 'us'").count() == 20


def test_weighted_recall_and_ablation(spark):
    parts = spark.createDataFrame([(9, 10), (10, 90)], "hits long, total long")
    assert evaluate.weighted_recall(parts).first().recall == pytest.approx(0.19)
    df = spark.createDataFrame([(f"S1-{i}", float(i % 2), 0.0, i % 2) for i in range(80)], "s1_id string, a double, b double, y int")
    fit = lambda train, test, columns: test.select("y", sum((F.col(c) for c in columns), F.lit(0.0)).alias("p"))
    metric = lambda out: out.agg(F.avg((F.col("p") == F.col("y")).cast("int"))).first()[0]
    got = {r["removed"]: r["marginal"] for r in model.ablate(fit, df, {"first": ["a"], "second": ["b"]}, ["a", "b"], metric)}
    assert got["<none>"] == 0 and got["first"] > 0.2 and got["second"] == 0


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, *_):
            return self.value

    def session(master, value=None):
        s = type("S", (), {})()
        s.conf, s.sparkContext = Conf(value), type("C", (), {"master": master})()
        return s

    assert durable.shared_dir(session("local[2]")) == durable.UNSET_DIR and durable.shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            durable.shared_dir(session(master))


def test_streams(spark, tmp_path):
    recs = "entity_id string, source string, country string, name string, address string"
    targets = spark.createDataFrame([("S2-1", "S2", "US", "Acme Foods Inc", "1 Elm St"), ("S2-2", "S2", "US", "Other Thing", "2 Oak St")], recs)
    spark.createDataFrame([("S1-1", "S1", "US", "Foods Acme LLC", "1 Elm St")], recs).write.parquet(f"{tmp_path}/in")
    found = []
    query = match_stream(spark.readStream.schema(recs).parquet(f"{tmp_path}/in"), targets, lambda df, n: found.extend((n, r.s1_id, r.cand_id) for r in df.collect()), f"{tmp_path}/state")
    query.awaitTermination()
    assert found == [(0, "S1-1", "S2-1")]
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as at, cast(id as double) as score from range(30)").write.parquet(f"{tmp_path}/scores")
    rates = candidate_rates(spark.readStream.schema("at timestamp, score double").parquet(f"{tmp_path}/scores"), "at")
    rates.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/rates").trigger(availableNow=True).start().awaitTermination()
    assert [(r.n_pairs, r.best) for r in spark.table("rates").orderBy("start").collect()] == [(10, 9.0), (10, 19.0), (10, 29.0)]


def test_search_asks_seldom_whether_long_lists_matter(monkeypatch):
    n, m = 5000, 40
    rng = np.random.default_rng(3)
    weights = rng.random((n, m)) + 0.01
    weights /= np.sqrt((weights**2).sum(1, keepdims=True))
    lists = tfidf.Lists(np.tile(np.arange(m), n), np.full(n, m), weights.ravel())
    asked, real = [], np.partition
    monkeypatch.setattr(tfidf.np, "partition", lambda *a: asked.append(1) or real(*a))
    q = weights[17]
    docs, score = lists.best(np.arange(m), q, 10, 6)
    want = np.floor(weights @ q * 1e6 + 0.5) / 1e6
    order = np.lexsort((np.arange(n), -want))[:10]
    assert docs.tolist() == order.tolist() and score == pytest.approx(want[order])
    assert len(asked) <= 12


def test_search_meets_copies_once(spark, monkeypatch):
    text = lambda i: ["a", "b", "c"][: 1 + i % 3]
    rows = [(i, "p", t, 1 / len(text(i)) ** 0.5) for i in range(60) for t in text(i)]
    q = spark.createDataFrame(rows, "id long, part string, term string, w double")
    assert tfidf._classes(tfidf.packed(q)).count() == 3
    got = {(r.q, r.d): r.score for r in tfidf.cosine_search(q, q, 25).collect()}
    score = lambda i, j: round(len({*text(i)} & {*text(j)}) / (len(text(i)) * len(text(j))) ** 0.5, 6)
    want = {(i, j): score(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (-score(i, j), j))[:25]}
    assert got == pytest.approx(want) and got.keys() == want.keys()


def test_cosines_of_pairs_in_any_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{s}{i}", p, f"t{int(t)}", float(w)) for s in "qd" for p in ("x", "y") for i in range(25) for t, w in zip(rng.permutation(12)[:4], rng.random(4) + 0.1)]
    vectors = spark.createDataFrame(rows, "id string, part string, term string, w double")
    q, d = (tfidf.packed(vectors.where(F.col("id").startswith(s))) for s in "qd")
    pairs = [(p, f"q{i}", f"d{j}", i * j) for p in ("x", "y", "z") for i in range(27) for j in range(0, 27, 2)]
    weight = {r[:3]: r[3] for r in rows}
    terms = {r[2] for r in rows}
    want = sorted((*r, round(sum(weight.get((r[1], r[0], t), 0) * weight.get((r[2], r[0], t), 0) for t in terms), 6)) for r in pairs)
    asked = spark.createDataFrame(pairs, "part string, q string, d string, n int")
    for options in ({}, {"block_queries": 4, "block_docs": 7}):
        got = tfidf.cosine_pairs(asked, q, d, "cos", **options)
        assert got.columns == [*asked.columns, "cos"]
        assert [(*r[:4], pytest.approx(r[4], abs=1.1e-6)) for r in want] == sorted(map(tuple, got.collect()))


def test_no_vector_goes_along_with_each_pair(spark):
    one = [("x", "p", f"t{t}", 0.1) for t in range(100)]
    vectors = tfidf.packed(spark.createDataFrame(one, "id string, part string, term string, w double"))
    asked = spark.range(5).select(F.lit("p").alias("part"), F.lit("x").alias("q"), F.lit("x").alias("d"))
    plan = tfidf.cosine_pairs(asked, vectors, vectors, "cos")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(" not in plan
