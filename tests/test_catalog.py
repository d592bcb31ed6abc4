"""Every query with SQL gives the rows of its SQL; the others run and have their columns."""

import math
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from rookery.functions import similarity as S
from rookery.functions import text as T
from rookery.operators.features import COLUMNS
from rookery.plans import catalog
from rookery.sources import records as R

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canon(rows):
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(catalog.SQL[name])
    assert cols == sorted(want.columns)
    assert canon(df.select(cols).collect()) == canon(con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall())


def test_feature_matrix_has_77_columns_in_order(spark, sf):
    df = catalog.feature_matrix_77(spark, sf)
    assert len(COLUMNS) == 77 and df.columns == ["s1_id", "cand_id", *COLUMNS]
    assert df.count() == catalog.block_exact_core(spark, sf).count()


def test_text_queries_over_all_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, sf, "documents").select("doc_id", "text").collect()}
    folded = spark.createDataFrame([(i, unicodedata.normalize("NFKC", t).casefold()) for i, t in texts.items()], "doc_id long, text string")
    want = {r.doc_id: r.norm for r in folded.select("doc_id", T.normalize_native("text").alias("norm")).collect()}
    assert {r.doc_id: r.norm for r in catalog.normalize_unicode(spark, sf).collect()} == want
    deva = {r.doc_id: r.t for r in catalog.table(spark, sf, "documents").select("doc_id", R.devanagari(T.text("text")).alias("t")).collect()}
    assert {r.doc_id: r.script for r in catalog.dominant_script(spark, sf).collect()} == {i: T.script_of(deva[i] if i % 3 == 0 else t) for i, t in texts.items()}
    letters = re.compile("[\u0900-\u097f]")
    assert {r.doc_id: r.latin for r in catalog.transliterate(spark, sf).collect()} == {i: T.romanize(t) for i, t in deva.items() if letters.search(t)}


def test_romanised_names_take_part(spark, sf):
    """Some hits come from second documents, and some true partners are written in another script."""
    assert {r["pass"] for r in catalog.tfidf_name_topk(spark, sf).select("pass").distinct().collect()} == {"P2", "P4"}
    assert catalog.true_pair_structure(spark, sf).first().n_cross_script > 0
    assert catalog.prepared(spark, sf).where("tr <> ''").count() > 10


def test_fuzzy_ratios_equal_brute_force(spark, sf):
    recs = {r.entity_id: r for r in catalog.prepared(spark, sf).collect()}
    rows = catalog.fuzzy_ratios(spark, sf).collect()
    assert len(rows) > 20
    cut = lambda v: round(v if v >= S.CUTOFF else 0.0, 6)
    for r in rows:
        x, y = recs[r.s1_id].n, recs[r.cand_id].n
        assert (r.name_ratio, r.name_token_sort_ratio, r.name_token_set_ratio) == (cut(S.ratio(x, y)), cut(S.token_sort_ratio(x, y)), cut(S.token_set_ratio(x, y)))
        assert r.name_seqratio == round(S.sequence_ratio(x, y), 6)


def test_queries_without_sql_use_the_full_normal_form(spark, sf, monkeypatch):
    recs = catalog.records(spark, sf).limit(1)
    name = lambda i, source, text: recs.withColumns({"entity_id": F.lit(i), "source": F.lit(source), "name": F.lit(text)})
    rows = name("S1-1", "S1", "Straße Bau").unionByName(name("S2-1", "S2", "STRASSE BAU")).unionByName(name("S1-2", "S1", "राम मोहन")).unionByName(name("S2-2", "S2", "राम मोहन"))
    monkeypatch.setattr(catalog, "records", lambda *_: rows)
    assert not {"fuzzy_ratios", "feature_matrix_77", "gbt_scores", "end_to_end_match"} & set(catalog.SQL)
    for q in (catalog.feature_matrix_77, catalog.fuzzy_ratios):
        assert {(r.s1_id, r.cand_id) for r in q(spark, sf).collect()} >= {("S1-1", "S2-1"), ("S1-2", "S2-2")}


def test_model_runs_end_to_end(spark, sf):
    rows = catalog.end_to_end_match(spark, sf).collect()
    assert len(rows) == catalog.records(spark, sf).where("source = 'S1'").count()
    assert any(r.matched_entity_ids for r in rows)


def test_entry_and_guard():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q[: q.index("_") + 1] for q in e.queries() if q.startswith("op")} or e.llm_queries is None


def test_scripts_with_as_many_letters_follow_the_sql(spark, tmp_path):
    texts = ["é a", "a é", "aé éb", "È ééaux éenê épaè.", "a", "é", "", None]
    spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.dominant_script(spark, str(tmp_path)).select("doc_id", "script").collect()
    assert canon(got) == canon(own.sql(catalog.SQL["dominant_script"]).fetchall())
    assert T.script_of("अ a") == "DEVANAGARI" and T.script_of("अ a", ("LATIN", "DEVANAGARI")) == "LATIN"
