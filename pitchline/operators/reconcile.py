"""Predictions against results: the latest prediction of each match, scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import argmax_label, result
from .metrics import row_brier, row_log_loss

KEY = ["home_team", "away_team", "match_date"]
FILE_NAME = r"predictions_.+_R\d+_(\d{8}_\d{6})\.json$"


def latest_per_match(predictions: DataFrame, kickoff: str | None = None) -> DataFrame:
    """The newest prediction of each match (a tie keeps the first by model_version); with ``kickoff`` only those made before it.

    One aggregation: the row is carried in the maximum, nothing is sorted.
    """
    rows = predictions if kickoff is None else predictions.filter(F.col("prediction_time") < F.col(kickoff))
    other = [c for c in rows.columns if c not in KEY]
    tie = "model_version" if "model_version" in other else other[0]
    best = rows.groupBy(*KEY, "prediction_time").agg(F.min_by(F.struct(*other), tie).alias("r"))
    return best.groupBy(*KEY).agg(F.max_by("r", "prediction_time").alias("r")).select(*KEY, "r.*")


def score_history(latest: DataFrame, actual: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """New history rows: predictions with a result (KEY, actual_home, actual_away) that ``history`` doesn't hold yet."""
    rows = latest if history is None else latest.join(history.select(*KEY).distinct(), KEY, "left_anti")
    j = rows.join(actual, KEY).withColumn("y", result(F.col("actual_home"), F.col("actual_away")))
    return j.select("prediction_time", *KEY, "p_h", "p_d", "p_a", argmax_label(F.col("p_h"), F.col("p_d"), F.col("p_a")).alias("predicted_result"), "actual_home", "actual_away", F.col("y").alias("actual_result"), (argmax_label(F.col("p_h"), F.col("p_d"), F.col("p_a")) == F.col("y")).alias("correct"), F.round(row_brier(), 4).alias("brier_score"), F.round(row_log_loss(), 4).alias("log_loss"), "model_version")


def pending(latest: DataFrame, actual: DataFrame) -> DataFrame:
    return latest.join(actual.select(*KEY), KEY, "left_anti").agg(F.count("*").alias("pending"))


def summary(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("hit_rate"), F.avg("brier_score").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"))
