import duckdb
import pytest

from rookery.llm import queries

TABLES = "documents pages labels benchmark embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        out = f"{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= left and now
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name in ("near_dedup", "decontamination", "quality_classifier"):
            assert now < left
        left = now
    assert docs.where("size(ids) <> n_tokens").count() == 0
