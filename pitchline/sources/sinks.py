"""Sinks: idempotent partitions, appends, documents, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_seasons(df: DataFrame, path: str, season: str = "SeasonStartYear") -> None:
    """Replaces the seasons in ``df`` and leaves the others; reads by season then skip the other folders."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, existing: DataFrame | None, path: str, keys: list[str]) -> None:
    """Appends the rows whose key ``existing`` lacks; running it twice changes nothing."""
    new = df if existing is None else df.join(existing.select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)


def match_report(documents: DataFrame) -> DataFrame:
    """(match_id, report): the text block of each prediction."""
    lines = [
        F.format_string("%s v %s", "home_team", "away_team"), F.format_string("Home %.1f%%  Draw %.1f%%  Away %.1f%%", *[F.col(c) * 100 for c in ("p_home_win", "p_draw", "p_away_win")]),
        F.format_string("Expected goals %.2f - %.2f, most likely %s", "expected_home_goals", "expected_away_goals", "predicted_score"), F.format_string("Over 2.5 %.1f%%  Both score %.1f%%", F.col("p_over_2_5") * 100, F.col("p_btts_yes") * 100), F.format_string("Confidence %s", "confidence"),
    ]
    return documents.select("match_id", F.concat_ws("\n", *lines).alias("report"))


def model_card(version: str, rows: dict[str, int], reports: list[dict]) -> str:
    """A Markdown card of a model version."""
    head = [f"# Model {version}", "", *[f"- {k}: {v} matches" for k, v in rows.items()], "", "| model | accuracy | log loss | Brier | AUC | ECE |", "|---|---|---|---|---|---|"]
    return "\n".join(head + ["| {model} | {accuracy:.4f} | {log_loss:.4f} | {brier:.4f} | {auc:.4f} | {ece_home:.4f} |".format(**r) for r in reports]) + "\n"


def history_page(history: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` rows for a report page."""
    return history.orderBy(F.col("prediction_time").desc(), "match_date", "home_team", "away_team").limit(n)
