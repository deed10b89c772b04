"""Reconciliation with the state of each match in the stream: its latest prediction and its result, in whatever order they come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reconcile import KEY, score_history
from ..plans.ledger import Ledger

_EVENT = "home_team string, away_team string, match_date date, at timestamp, model_version string, p_h double, p_d double, p_a double, actual_home int, actual_away int"
_STATE = "made long, version string, p_h double, p_d double, p_a double, home int, away int, told long"
_SETTLED = "home_team string, away_team string, match_date date, prediction_time timestamp, model_version string, p_h double, p_d double, p_a double, actual_home int, actual_away int"


def _settle(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a match's latest prediction and first told result; once no earlier event can come, the match is settled."""
    now = list(state.get) if state.exists else [None, None, None, None, None, None, None, None]
    if state.hasTimedOut:
        made, version, p_h, p_d, p_a, home, away, _ = now
        state.remove()
        if made is not None and home is not None:
            yield pd.DataFrame([(*key, pd.Timestamp(made, unit="us"), version, p_h, p_d, p_a, home, away)], columns=[c.split()[0] for c in _SETTLED.split(", ")])
        return
    for batch in batches:
        for e in batch.itertuples(index=False):
            at = pd.Timestamp(e.at).value // 1000
            if pd.isna(e.actual_home):
                if now[0] is None or (at, _later(e.model_version)) > (now[0], _later(now[1])):
                    now[:5] = at, e.model_version, e.p_h, e.p_d, e.p_a
            elif now[7] is None or (at, e.actual_home, e.actual_away) < (now[7], now[5], now[6]):
                now[5:] = int(e.actual_home), int(e.actual_away), at
    state.update(tuple(now))
    # a match with a result waits for the watermark to pass it; one without waits for its result
    if now[7] is not None:
        state.setTimeoutTimestamp(max(now[7] // 1000 + 1, state.getCurrentWatermarkMs() + 1))


class _later(str):
    """Of predictions of one time the one whose version comes first counts, as elsewhere."""

    def __gt__(self, other: str) -> bool:
        return str.__lt__(self, other)

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


def settled_matches(predictions: DataFrame, results: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of matches with their latest prediction and their result, each once.

    ``predictions``: KEY, prediction_time, model_version, p_h, p_d, p_a; ``results``: KEY, told_at, actual_home, actual_away.
    A match is settled when the watermark, ``delay`` behind the newest event, passes its result; what comes later than that is
    dropped, so the rows don't depend on the order of arrival within the delay.  Rows without a time, and results without
    both goals, are dropped.
    """
    made = predictions.filter("prediction_time is not null").select(*KEY, F.col("prediction_time").alias("at"), "model_version", "p_h", "p_d", "p_a", F.lit(None).cast("int").alias("actual_home"), F.lit(None).cast("int").alias("actual_away"))
    none = [F.lit(None).cast("string").alias("model_version"), *[F.lit(None).cast("double").alias(p) for p in ("p_h", "p_d", "p_a")]]
    told = results.filter("told_at is not null and actual_home is not null and actual_away is not null").select(*KEY, F.col("told_at").alias("at"), *none, F.col("actual_home").cast("int").alias("actual_home"), F.col("actual_away").cast("int").alias("actual_away"))
    events = made.unionByName(told).withWatermark("at", delay)
    return events.groupBy(*KEY).applyInPandasWithState(_settle, _SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def reconcile_states(predictions: DataFrame, results: DataFrame, history: str, checkpoint: str, delay: str = "1 day", once: bool = True) -> StreamingQuery:
    """Starts a query that commits settled matches, scored, to the ledger ``history``; a batch that is run again commits once."""

    def add(batch: DataFrame, number: int) -> None:
        rows = score_history(batch.drop("actual_home", "actual_away"), batch.select(*KEY, "actual_home", "actual_away"))
        Ledger(batch.sparkSession, history).append(lambda old: rows, f"{checkpoint}#{number}")

    writer = settled_matches(predictions, results, delay).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
