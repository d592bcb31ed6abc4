"""Readers of record, truth, candidate and prediction files, and the record view of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.text import country_key, raw_tokens

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
LONG = "s1_entity_id string, candidate_entity_id string, source string, score double"
PREDICTION = "s1_entity_id string, candidate_entity_id string, prob double"
WIDE = "source1_entity_id string, candidate_entity_ids string"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """Raw tab-separated fields: quotes are text, ragged rows are dropped, empty fields are empty strings."""
    df = spark.read.schema(schema).options(sep="\t", quote="", header=header, mode="DROPMALFORMED", emptyValue="", nullValue="\u0000").csv(path)
    return df.fillna("")


def read_records(spark: SparkSession, path: str | list[str], country: str | None = None) -> DataFrame:
    """Records with their source and country key; ``country`` filters in the scan's stage."""
    df = read_tsv(spark, path, RECORD).withColumns({"source": F.substring("entity_id", 1, 2), "ck": country_key("country")})
    return df if country is None else df.where(F.col("ck") == country_key(F.lit(country)))


def write_partitioned(records: DataFrame, path: str, salts: int = 16) -> None:
    """Parquet by country, so that later country filters prune folders; each country is dealt to ``salts`` tasks."""
    records.repartition("ck", F.pmod(F.xxhash64("entity_id"), F.lit(salts))).write.mode("overwrite").partitionBy("ck").parquet(path)


def pending(countries: DataFrame, path: str) -> list[str]:
    """Countries (column ``ck``) of which ``path`` holds no finished output yet, in order: where a run that broke off goes on.

    There are as many as countries, a few hundred at most.
    """
    spark = countries.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda ck: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ck={ck}/_SUCCESS"))
    return [r.ck for r in countries.select("ck").distinct().orderBy("ck").collect() if not done(r.ck)]


def resume(records: DataFrame, path: str, work) -> list[str]:
    """Writes ``work`` of each country that is still pending as a folder of its own; returns those it did."""
    did = pending(records, path)
    for ck in did:
        work(records.where(F.col("ck") == ck)).write.mode("overwrite").parquet(f"{path}/ck={ck}")
    return did


def partition_order(counts: DataFrame, order: str = "descending") -> list[str]:
    """Countries by number of records, ``ascending`` or ``descending``, or by name (``natural``)."""
    by = {"ascending": [F.asc("n"), F.asc("ck")], "descending": [F.desc("n"), F.asc("ck")], "natural": [F.asc("ck")]}[order]
    return [r.ck for r in counts.orderBy(*by).collect()]


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("ck").agg(F.count("*").alias("n"))


def read_truth(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """(s1_id, matched array).  Entities that match nothing are kept unless told otherwise."""
    df = read_tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("s1_id"), F.filter(F.split("matched_entity_ids", ","), lambda x: x != "").alias("matched"))
    return df if keep_empty else df.where(F.size("matched") > 0)


def read_long_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = read_tsv(spark, path, LONG)
    return df.select(F.col("s1_entity_id").alias("s1_id"), F.col("candidate_entity_id").alias("cand_id"), "source", F.col("score").cast("float").cast("double").alias("score"))


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Any number of prediction files as one."""
    df = read_tsv(spark, paths, PREDICTION)
    return df.select(F.col("s1_entity_id").alias("s1_id"), F.col("candidate_entity_id").alias("cand_id"), "prob")


def read_required_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(s1_id, place): S1 ids of a record file; ``place`` sorts them in the order of the file, however it is split."""
    df = spark.read.schema(RECORD).options(sep="\t", quote="", header=True, mode="DROPMALFORMED").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("entity_id").alias("s1_id"), place.alias("place")).where(F.col("s1_id").startswith("S1-"))


def in_chunks(pairs: DataFrame, max_pairs: int, max_per_s1: int | None = None, score: str = "score") -> DataFrame:
    """``pairs`` with a number ``chunk``, about ``max_pairs`` to each; the pairs of an S1 entity are never parted."""
    pairs = pairs if max_per_s1 is None else top_per_entity(pairs, max_per_s1, score)
    n = max(1, -(-pairs.count() // max_pairs))
    return pairs.withColumn("chunk", F.pmod(F.xxhash64("s1_id"), F.lit(n)).cast("int"))


def referenced(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the records whose id (column ``id``) is asked for."""
    return records.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def unresolved(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that no record has."""
    return ids.join(records.select(F.col("entity_id").alias("id")), "id", "left_anti")


def top_per_entity(pairs: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The ``n`` best pairs of each S1 entity; ties to the smaller candidate."""
    from pyspark.sql.window import Window

    best = Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id")
    return pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r")


# Latin letters in Devanagari, consonants with a virama, for records that are to have a name of that script.
DEVANAGARI = dict(zip("bcdfghjklmnpqrstvwxyz", "बचडफगहजकलमनपकरसटववखयज", strict=True))
VOWELS = dict(zip("aeiou", "अएइओउ", strict=True))


def devanagari(c: Column) -> Column:
    """A Latin text letter by letter in Devanagari; other characters stay."""
    plain = F.translate(F.lower(c), "".join(VOWELS), "".join(VOWELS.values()))
    return F.regexp_replace(F.translate(plain, "".join(DEVANAGARI), "".join(DEVANAGARI.values())), "([क-ह])", "$1्")


def records_view(documents: DataFrame) -> DataFrame:
    """Documents as records: source by number, language as country, 6 words of name, 8 of address.

    One in seven targets bears its name in Devanagari.
    """
    number = F.substring("source", 4, 10).cast("int")
    source = F.when(number < 4, "S1").when(number < 12, "S2").otherwise("S3")
    words = raw_tokens(F.col("text"), 14)
    name = F.array_join(F.slice(words, 1, 6), " ")
    return documents.select(
        F.concat_ws("-", source, F.col("doc_id").cast("string")).alias("entity_id"),
        "doc_id",
        source.alias("source"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.when((source != "S1") & (F.col("doc_id") % 7 == 3), devanagari(name)).otherwise(name).alias("name"),
        F.array_join(F.slice(words, 7, 8), " ").alias("address"),
        F.substring("text", 1, 40).alias("prefix"),
    )


def truth_view(records: DataFrame) -> DataFrame:
    """(s1_id, cand_id): same first 40 characters and country, each candidate with the smallest S1."""
    own = records.where("source = 'S1'").groupBy("country", "prefix").agg(F.min("doc_id").alias("s1"))
    cand = records.where("source <> 'S1'").select("country", "prefix", F.col("entity_id").alias("cand_id"))
    return cand.join(own, ["country", "prefix"]).select(F.concat(F.lit("S1-"), F.col("s1").cast("string")).alias("s1_id"), "cand_id")
