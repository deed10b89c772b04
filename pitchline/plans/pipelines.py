"""The reference's command-line stages as plans: features, training, prediction, backtest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble, form, fuzzy, metrics, predict, rating, scores, splits
from . import models, score_fit
from .lineage import cut, table

SCORE_MODEL = "Poisson"


def training_dataset(matches: DataFrame, rated: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """Keys, outcome and pre-match features of every match; none of the match's own statistics.  ``width``: days of a piece of a team's log."""
    rated = rating.elo(matches) if rated is None else rated
    keep = [c for c in ("MatchID", "Season", "SeasonStartYear", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "Referee") if c in matches.columns]
    wide = form.merge_sides(matches.select(*keep), form.form_features(form.team_log(matches), width))
    return rating.with_ratings(wide, rated)


def score_probabilities(rows: DataFrame, model: score_fit.ScoreModel, key: str = "MatchID") -> DataFrame:
    r = scores.with_rates(rows.select(key, "HomeTeam", "AwayTeam"), model.teams(rows.sparkSession), model.base, model.advantage)
    return scores.marginals(r, model.rho).select(key, F.lit(SCORE_MODEL).alias("model"), F.col("P_HomeWin").alias("p_h"), F.col("P_Draw").alias("p_d"), F.col("P_AwayWin").alias("p_a"))


def fuzzy_probabilities(rows: DataFrame, key: str = "MatchID") -> DataFrame:
    return fuzzy.infer(rows, key).select(key, F.lit("Fuzzy").alias("model"), F.col("Fuzzy_P_HomeWin").alias("p_h"), F.col("Fuzzy_P_Draw").alias("p_d"), F.col("Fuzzy_P_AwayWin").alias("p_a"))


@dataclass
class Trained:
    columns: list[str]
    classifiers: dict[str, models.Fitted]
    scores: score_fit.ScoreModel
    weights: DataFrame
    platt: ensemble.Platt
    reports: DataFrame

    def members(self, rows: DataFrame) -> DataFrame:
        """Every member's probabilities of every row, one after the other."""
        out = score_probabilities(rows, self.scores).unionByName(fuzzy_probabilities(rows))
        for f in self.classifiers.values():
            out = out.unionByName(f.probabilities(rows, "MatchID"))
        return out

    def blended(self, rows: DataFrame, calibrated: bool = True) -> DataFrame:
        b = ensemble.blend(self.members(rows), self.weights, "MatchID")
        return self.platt.apply(b) if calibrated else b


def train(dataset: DataFrame, current: int | None = None, entries: dict[str, models.Entry] | None = None) -> Trained:
    """Fits on Train, weighs and calibrates on Validation; Test isn't touched."""
    split = table(splits.chronological_split(dataset, "SeasonStartYear", current))
    tr, va = (split.filter(F.col("split") == s) for s in ("Train", "Validation"))
    columns = models.with_values(tr, models.feature_columns(dataset))
    fitted = models.fit_all(tr, columns, entries=entries)
    score = score_fit.fit(tr)
    half = Trained(columns, fitted, score, None, None, None)
    y = va.select("MatchID", F.col("FTR").alias("y"))
    members = cut(half.members(va).join(y, "MatchID"))
    reports = cut(metrics.full_report(members, ["model"]))
    weights = cut(ensemble.log_loss_weights(reports))
    platt = ensemble.fit_platt(ensemble.blend(members, weights, "MatchID").join(y, "MatchID"))
    return Trained(columns, fitted, score, weights, platt, reports)


def production(trained: Trained, dataset: DataFrame, entries: dict[str, models.Entry] | None = None) -> Trained:
    """Members refitted on all rows with a result; columns, weights and calibration stay those of ``trained``."""
    rows = cut(dataset.filter(F.col("FTR").isNotNull()))
    known = {k: e for k, e in (entries or models.registry()).items() if k in trained.classifiers}
    return Trained(trained.columns, models.fit_all(rows, trained.columns, entries=known), score_fit.fit(rows), trained.weights, trained.platt, trained.reports)


def predict_round(trained: Trained, calendar: DataFrame, history: DataFrame, season: int, round_number: int, version: str) -> DataFrame:
    """Prediction documents of a round: serving features, members, blend, calibration, scores, influences."""
    rows = predict.upcoming(calendar, season, round_number)
    rated = cut(rating.elo(history))
    features = cut(form.features_for_upcoming(rows, form.team_log(history), rating.latest_ratings(rated)))
    p = cut(trained.blended(features))
    rates = scores.with_rates(features.select("MatchID", "HomeTeam", "AwayTeam"), trained.scores.teams(calendar.sparkSession), trained.scores.base, trained.scores.advantage)
    grid = scores.top_scores(scores.marginals(rates, trained.scores.rho), trained.scores.rho).drop("HomeTeam", "AwayTeam")
    forest = next((f for f in trained.classifiers.values() if f.importances()), None)
    importance = forest.importances() if forest else {}
    factors = predict.influences(features, "MatchID", importance, models.sample_deviation(training_dataset(history, rated), trained.columns) if importance else {})
    return predict.document(rows.join(p, "MatchID").join(grid, "MatchID").join(factors, "MatchID"), version)


def backtest(dataset: DataFrame, trained: Trained, entries: dict[str, models.Entry] | None = None, current: int | None = None) -> DataFrame:
    """Walk-forward: (MatchID, season, y, p_h, p_d, p_a) of each fold's test season, members refitted on all seasons before.

    Weights and calibration stay those of ``trained``.
    """
    seasons = [r[0] for r in splits.ranked_seasons(dataset, "SeasonStartYear", current).orderBy("season_index").collect()]
    out = None
    for i in range(splits.backtest_floor(len(seasons)), len(seasons)):
        tr = dataset.filter(F.col("SeasonStartYear").isin(seasons[:i]))
        te = dataset.filter(F.col("SeasonStartYear") == seasons[i])
        fold = Trained(trained.columns, models.fit_all(tr, trained.columns, entries=entries), score_fit.fit(tr), trained.weights, trained.platt, trained.reports)
        p = cut(fold.blended(te).join(te.select("MatchID", F.col("SeasonStartYear").alias("season"), F.col("FTR").alias("y")), "MatchID"))
        out = p if out is None else out.unionByName(p)
    return out


def pooled_report(backtested: DataFrame, most: int = 3) -> DataFrame:
    """Reports over the pooled rows of the last 1 to ``most`` seasons."""
    return metrics.full_report(splits.pooled_last(backtested, "season", most), ["last_n"])
