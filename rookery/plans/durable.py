"""Tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all its tasks run in this process, as in tests.
UNSET_DIR = "/tmp/checkpoints/rookery"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return UNSET_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike a cached or locally checkpointed frame it does not live on one
    executor, later reads decode only the columns they need, and Spark knows
    its size.  The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
