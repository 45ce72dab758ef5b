"""Cutting long plans: results go to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own, a cluster must name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    few: for a small table that a wide scan makes, one file per so many bytes instead of one per scan task.
    """
    path = fresh_path(df.sparkSession, name)
    df = df.hint("rebalance") if few else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
