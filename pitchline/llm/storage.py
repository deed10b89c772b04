"""Cutting lineage through the checkpoint folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and all runs on one machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/pitchline"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; on a local master a local one if none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or FALLBACK_DIR)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder (columnar, prunable)."""
    path = f"{checkpoint_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in a folder of their own in the shared checkpoint folder, dropped together when nothing needs them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/r-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(name: str) -> Column:
    """A join key by which the result of a grouping by ``name`` doesn't count as dealt out yet.

    Both sides of the join are then shuffled by it, and Spark can split the rows of a frequent key.
    """
    return F.bitwise_not(F.col(name))


def inner(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` bears, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
