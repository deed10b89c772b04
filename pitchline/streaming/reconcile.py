"""Predictions as a stream: every micro-batch adds what its matches' results allow, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.reconcile import KEY, latest_per_match, score_history


def reconcile_stream(predictions: DataFrame, results: Callable[[SparkSession], DataFrame], history: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that appends scored predictions to the Parquet table ``history``.

    A batch that is run again after a failure finds its rows in the history and appends nothing.  The newest
    prediction of a match within its batch counts; matches already in the history stay as they are.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(history)
        except Exception as e:  # noqa: BLE001  no history yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = None
        new = score_history(latest_per_match(batch), results(spark), old if old is None else old.select(*KEY))
        new.write.mode("append").parquet(history)

    writer = predictions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
