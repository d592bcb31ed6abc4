"""Matching of arriving records against a static set of targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rookery.operators.blocking import BlockConfig, key_block_rescored, prepare
from rookery.plans.durable import materialize


def match_stream(arriving: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: BlockConfig = BlockConfig(), unicode: bool = True) -> StreamingQuery:
    """Blocks each micro-batch of S1 records against ``targets`` and hands the ranked candidates to ``sink``.

    The targets' derived text is written once, before the stream starts, and read by every batch.
    ``sink`` gets the batch number, so a writer that overwrites a batch's folder
    delivers each batch once.
    """
    index = materialize(prepare(targets, unicode), "stream-targets")

    def batch(df: DataFrame, number: int) -> None:
        sink(key_block_rescored(materialize(prepare(df, unicode), "stream-batch").unionByName(index), cfg), number)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidate_rates(candidates: DataFrame, at: str, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, n_pairs, best): candidates of a stream with an event time ``at``, by window; rows later than ``late`` are left out."""
    times = F.window(at, window, slide) if slide else F.window(at, window)
    return candidates.withWatermark(at, late).groupBy(times.alias("w")).agg(F.count("*").alias("n_pairs"), F.max("score").alias("best")).select("w.start", "w.end", "n_pairs", "best")
