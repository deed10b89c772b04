"""From fixtures to prediction documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_id
from ..functions.probability import argmax_label, confidence

#: Paired features in the ranking of influences, their labels, and those where less is better.
FACTORS = {
    "Result_L5": "Recent results (last 5)", "Result_L10": "Recent results (last 10)", "GF_L10": "Goals scored (last 10)", "GA_L10": "Goals conceded (last 10)", "ShotsF_L5": "Shots (last 5)",
    "SOTF_L5": "Shots on target (last 5)", "VenueResult_L5": "Results at the venue (last 5)", "RestDays": "Rest days", "MatchesLast14Days": "Matches in the last 14 days",
}
REVERSED = ("GA_L10",)


def next_round(calendar: DataFrame, season: int | None = None) -> DataFrame:
    """One row: the smallest round with an unplayed fixture; null if there is none."""
    rows = calendar.filter(~F.col("Played"))
    rows = rows if season is None else rows.filter(F.col("SeasonStartYear") == season)
    return rows.agg(F.min("RoundNumber").alias("next_round"))


def next_round_by_date(calendar: DataFrame, as_of: date) -> DataFrame:
    """One row: the round of the earliest unplayed fixture from ``as_of`` on, so one postponed match holds nothing up."""
    rows = calendar.filter(~F.col("Played") & (F.to_date("Date") >= F.lit(as_of)))
    return rows.agg(F.min_by("RoundNumber", F.struct("Date", "RoundNumber")).alias("next_round"))


def upcoming(calendar: DataFrame, season: int, round_number: int, include_played: bool = False) -> DataFrame:
    """A round's fixtures with their MatchID; played ones only on request, for they would know their own result."""
    rows = calendar.filter((F.col("SeasonStartYear") == season) & (F.col("RoundNumber") == round_number))
    rows = rows if include_played else rows.filter(~F.col("Played"))
    return rows.select(match_id(F.col("Date"), F.col("HomeTeam"), F.col("AwayTeam")).alias("MatchID"), "RoundNumber", "Date", "HomeTeam", "AwayTeam")


def influences(df: DataFrame, key: str, importance: dict[str, float], spread: dict[str, float], top: int = 5) -> DataFrame:
    """(key, factors array<struct<label, score, favors>>): the largest standardised, importance-weighted differences.

    Within the row: candidates are an array, missing ones drop out, the rest are sorted by size, equal sizes by
    label.  Sizes count as equal if they are so to nine digits, for a product's last bits depend on how it is written.
    """
    parts = []
    size = lambda x: (-F.round(F.abs(x), 9)).alias("size")
    pairs = [(f"Home_{m}", f"Away_{m}", m, label) for m, label in FACTORS.items()]
    for h, a, m, label in pairs:
        if h in df.columns and a in df.columns:
            weight = (importance.get(h, 0.0) + importance.get(a, 0.0)) / 2 / (spread.get(h) or 1.0)
            diff = (F.col(h) - F.col(a)).cast("double") * (-1.0 if m in REVERSED else 1.0)
            parts.append(F.when(F.col(h).isNotNull() & F.col(a).isNotNull(), F.struct(size(diff * weight), F.lit(label).alias("label"), (diff * weight).alias("score"), F.when(diff > 0, "Home").otherwise("Away").alias("favors"))))
    if "EloDiffPre" in df.columns:
        diff = F.col("EloDiffPre") * (importance.get("EloDiffPre", 0.0) / (spread.get("EloDiffPre") or 1.0))
        parts.append(F.when(F.col("EloDiffPre").isNotNull(), F.struct(size(diff), F.lit("Rating difference").alias("label"), diff.alias("score"), F.when(F.col("EloDiffPre") > 0, "Home").otherwise("Away").alias("favors"))))
    if not parts:
        return df.select(key, F.expr("cast(array() as array<struct<label: string, score: double, favors: string>>)").alias("factors"))
    best = F.slice(F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull())), 1, top)
    return df.select(key, F.transform(best, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), x["favors"].alias("favors"))).alias("factors"))


def document(df: DataFrame, version: str) -> DataFrame:
    """Prediction documents: nested output of rows with p_h, p_d, p_a, rates, marginals, top_scorelines and factors."""
    probs = [F.col(c) for c in ("p_h", "p_d", "p_a")]
    have = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    return df.select(
        F.col("MatchID").alias("match_id"), F.lit(version).alias("model_version"), F.col("Date").alias("date"), F.col("RoundNumber").alias("round"), F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"),
        F.col("p_h").alias("p_home_win"), F.col("p_d").alias("p_draw"), F.col("p_a").alias("p_away_win"), argmax_label(*probs).alias("predicted_result"), F.try_element_at("top_scorelines", F.lit(1))["score"].alias("predicted_score"),
        F.col("rate_h").alias("expected_home_goals"), F.col("rate_a").alias("expected_away_goals"), F.col("P_Over25").alias("p_over_2_5"), F.col("P_Under25").alias("p_under_2_5"), F.col("P_BTTS_Yes").alias("p_btts_yes"), F.col("P_BTTS_No").alias("p_btts_no"),
        confidence(*probs).alias("confidence"), "top_scorelines", have("factors", "array<struct<label:string,score:double,favors:string>>").alias("top_influencing_factors"), have("per_model", "map<string,array<double>>").alias("per_model_raw_proba"), have("weights", "map<string,double>").alias("ensemble_weights_used"),
    )


#: The flat columns of a prediction file.
FLAT = ("date", "round", "home_team", "away_team", "p_home_win", "p_draw", "p_away_win", "predicted_score", "expected_home_goals", "expected_away_goals", "p_over_2_5", "p_under_2_5", "p_btts_yes", "p_btts_no", "confidence")


def flat(documents: DataFrame) -> DataFrame:
    return documents.select(*FLAT)


def confidence_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("confidence").agg(F.count("*").alias("n"))


def latest_version(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the model path with the highest version number; numbers, not names, are compared."""
    n = F.try_element_at(F.regexp_extract_all(path, F.lit(r"model_v(\d+)")), F.lit(1)).cast("int")
    return paths.agg(F.max_by(path, n).alias(path), (F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_version"))
