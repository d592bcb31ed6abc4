"""The thin opN_ queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import bpe, decontaminate, html_text, language_model, minhash, neighbours, quality, secrets, shards, url_filter
from rookery.llm.url_filter import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed values of the contract.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]

# The listed urls of the query: every page number of these sites in each language.
SITES = ["ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org"]
LANGS = ["de", "en", "es", "fr"]
NUMBERS = 1000


def listed_urls(spark: SparkSession) -> DataFrame:
    """``canonical`` urls of the sites above."""
    each = spark.range(NUMBERS).select("id", F.explode(F.split(F.lit(" ".join(SITES)), " ")).alias("site"))
    each = each.select("id", "site", F.explode(F.split(F.lit(" ".join(LANGS)), " ")).alias("lang"))
    return each.select(F.concat_ws("/", "site", "lang", F.col("id").cast("string")).alias("canonical"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed_urls(spark), RULES).drop("possible")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), named AS (
  SELECT *,
         CASE WHEN host = '' THEN NULL ELSE
           regexp_replace(CASE WHEN regexp_matches(regexp_replace(host, ':\d*$', ''), '^(www\.|m\.|blog\.)+[^.]+\.') THEN regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www\.|m\.|blog\.)+', '') ELSE regexp_replace(host, ':\d*$', '') END, '', '')
           || regexp_replace(path, '(\.html)?/*$', '') END AS canonical
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS r
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), listed AS (
  SELECT s || '/' || l || '/' || n AS canonical
  FROM (SELECT unnest(['ads-track.example.org', 'casino-win.example.org', 'cheap-pills.example.com', 'free-bets.example.com', 'spam-farm.example.org']) AS s),
       (SELECT unnest(['de', 'en', 'es', 'fr']) AS l), range(1000) AS t(n)
)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN u.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       u.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND f.r = 1 LEFT JOIN listed u ON u.canonical = n.canonical
"""


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.corpus_model(docs))


QUERIES = {"op1_url_filter": op1_url_filter, "op2_nearest_neighbours": op2_nearest_neighbours, "op3_sharding": op3_sharding, "op4_minhash_dedup": op4_minhash_dedup, "op5_bpe": op5_bpe, "op6_decontamination": op6_decontamination, "op7_lm_scoring": op7_lm_scoring, "op8_quality_classifier": op8_quality_classifier, "op9_html_extraction": op9_html_extraction, "op10_secret_scan": op10_secret_scan}
ORACLE_SQL = {"op1_url_filter": OP1_SQL}
