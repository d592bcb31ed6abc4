"""Command line: python -m rookery COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import assign, blocking, evaluate, features, model
from rookery.plans.durable import materialize
from rookery.sources import records as R
from rookery.sources import sinks


def named(records: DataFrame) -> DataFrame:
    """Record files as the operators take them."""
    return records.select("entity_id", "source", F.col("ck").alias("country"), F.col("business_name").alias("name"), F.col("business_address").alias("address"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rookery", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *needs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for n in needs:
            c.add_argument(f"--{n}", required=True, nargs="+" if n in ("records", "predictions") else None)
        return c

    c = command("block", "records to long candidates", "records", "out")
    c.add_argument("--passes", choices=["keys", "union"], default="keys")
    c.add_argument("--top-k", type=int, default=150)
    c.add_argument("--cap", type=int, default=400)
    c.add_argument("--n-rt", type=int, default=10)
    c.add_argument("--n-ra", type=int, default=6)
    c.add_argument("--country")
    command("wide", "long candidates to one row per S1", "records", "candidates", "out")
    command("train", "candidates and truth to a model and features", "records", "candidates", "truth", "out")
    c = command("predict", "candidates to probabilities", "records", "candidates", "model", "out")
    c.add_argument("--min-prob", type=float, default=0.02)
    c.add_argument("--max-per-s1", type=int)
    c = command("submit", "probabilities to match sets", "records", "predictions", "out")
    c.add_argument("--rule", choices=["expected", "threshold"], default="expected")
    c.add_argument("--tau", type=float, default=0.5)
    c.add_argument("--tau-singleton", type=float, default=0.3)
    c.add_argument("--max-k", type=int, default=8)
    command("evaluate", "match sets against the truth", "records", "results", "truth")
    command("recall", "recall of candidates at each K", "candidates", "truth")
    return p


def exploded(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matched").alias("cand_id"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rookery").getOrCreate()
    recs = named(R.read_records(spark, a.records, getattr(a, "country", None))) if "records" in a else None
    s1 = recs.where("source = 'S1'").select(F.col("entity_id").alias("s1_id")) if recs is not None else None
    if a.command == "block":
        cfg = blocking.BlockConfig(final_top_k=a.top_k, cap=a.cap, n_rare_name=a.n_rt, n_rare_addr=a.n_ra)
        prepared = materialize(blocking.prepare(recs), "records")
        pairs = (blocking.key_block_rescored if a.passes == "keys" else blocking.union_block)(prepared, cfg)
        sinks.write_tsv(sinks.long_rows(pairs), a.out)
    elif a.command == "wide":
        sinks.write_tsv(sinks.wide(R.read_long_pairs(spark, a.candidates), s1), a.out)
    elif a.command == "train":
        pairs = R.read_long_pairs(spark, a.candidates)
        x = materialize(evaluate.labelled(features.featurize(pairs, recs), exploded(R.read_truth(spark, a.truth))), "features")
        x.write.mode("overwrite").parquet(f"{a.out}/features")
        model.train(x, features.COLUMNS, trees=200).write().overwrite().save(f"{a.out}/model")
    elif a.command == "predict":
        from pyspark.ml import PipelineModel

        pairs = R.read_long_pairs(spark, a.candidates)
        pairs = R.top_per_entity(pairs, a.max_per_s1) if a.max_per_s1 else pairs
        probs = sinks.with_floor(model.score(PipelineModel.load(a.model), features.featurize(pairs, recs), features.COLUMNS), a.min_prob)
        sinks.write_tsv(probs.select(F.col("s1_id").alias("s1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), F.round("prob", 6).alias("prob")), a.out)
    elif a.command == "submit":
        probs = R.read_predictions(spark, a.predictions)
        kept = assign.expected_f05_assign(probs, a.max_k) if a.rule == "expected" else assign.threshold_assign(probs, a.tau, a.tau_singleton, a.max_k)
        sinks.write_tsv(sinks.wide(kept, s1, "matched_entity_ids", "prob"), a.out)
    elif a.command == "evaluate":
        evaluate.macro_f05(exploded(R.read_truth(spark, a.results)), exploded(R.read_truth(spark, a.truth)), s1).show(truncate=False)
    else:
        ranked = assign.ranked(R.read_long_pairs(spark, a.candidates), "score")
        evaluate.recall_at_k(ranked, exploded(R.read_truth(spark, a.truth)), [10, 20, 50, 100, 150]).show(truncate=False)


if __name__ == "__main__":
    main()
