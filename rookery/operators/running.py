"""Running sums over a whole table, or over each of a few groups, without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.plans.durable import materialize


def running(df: DataFrame, order: list[Column | str], sums: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``{c}_upto`` for each column c of ``sums``: its sum over the rows up to this one, in ``order`` within ``by``.

    Rows are dealt by ranges of the order, so a task sorts and sums its own range; the sums of the
    ranges before it, one row to each range and group, are added.  Rows that tie are summed in any order.
    """
    by = by or []
    dealt = materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "running")
    before = dealt.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_range", *by, *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    own = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumns({f"{c}_upto": F.sum(c).over(own) for c in sums})
    # Groups may be null, as a value is.
    names = ["_range", *by]
    match = [dealt[n].eqNullSafe(before[n]) for n in names]
    kept = [dealt[c] for c in df.columns]
    return dealt.join(before, match).select(*kept, *((dealt[f"{c}_upto"] + before[f"_{c}"]).alias(f"{c}_upto") for c in sums))
