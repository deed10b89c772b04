"""Cutting lineage between the stages of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all runs on one machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/pitchline"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; on a local master a local one if none is named."""
    if spark.sparkContext.getCheckpointDir() is None:
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named and master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or FALLBACK_DIR)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share, and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder; ``by``: columns whose values have folders of their own."""
    path = f"{checkpoint_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
