"""Command line: ``python -m pitchline.cli COMMAND --data FOLDER``, one command a stage of a season.

``update`` lands sources and builds tables, ``fuzzy`` and ``features`` rebuild single tables, ``train`` writes a model version,
``evaluate`` a walk-forward report, ``predict`` a round's documents and the latest pointer, ``collect`` scores
predictions against results, ``report`` the newest history for a page.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import current_season
from .functions.names import localised
from .operators import cleaning, fuzzy, metrics, predict, rating, reconcile, splits
from .plans import models, pipelines, store
from .plans.ledger import Ledger
from .sources import files, readers, sinks

#: Rows that the quality report lists of each kind of finding.
LISTED = 20


def update(spark: SparkSession, data: str, as_of: date, seasons_back: int = 9, force: bool = False, fetch: Callable[[str, str], str] = readers.fetch_csv) -> int:
    """Raw files to clean tables; 1 if a source failed, before anything is cleaned."""
    last, raw = current_season(as_of), lambda kind, s: f"{data}/raw/{kind}_{s}.csv"
    done, errors = readers.update_all(last, seasons_back, lambda kind, s, text: files.write_text(spark, raw(kind, s), text), lambda kind, s: files.exists(spark, raw(kind, s)), force, fetch)
    if done:
        spark.createDataFrame(done, "kind string, season int, downloaded_at string, row_count long, source_url string").write.mode("append").parquet(f"{data}/provenance")
    if errors:
        print(*errors, sep="\n", file=sys.stderr)
        return 1
    results = readers.results(spark, f"{data}/raw/results_*.csv")
    clean = cleaning.clean_results(results, [F.col("_file"), *[F.col(c) for c in cleaning.CORE]])
    sinks.write_seasons(clean, f"{data}/matches")
    matches = spark.read.parquet(f"{data}/matches")
    calendar = cleaning.fixture_calendar(readers.fixtures(spark, f"{data}/raw/fixtures_*.csv"), matches)
    sinks.write_table(calendar, f"{data}/calendar")
    listed = lambda df, *order: [r.asDict() for r in df.withColumns({c: F.col(c).cast("string") for c in df.columns}).orderBy(*order).limit(LISTED).collect()]
    counts = {k: int(v) for k, v in cleaning.quality_report(results, clean).first().asDict().items()}
    wide = cleaning.violations(matches, "MatchID", cleaning.BOUNDS)
    gaps = cleaning.schedule_gaps(spark.read.parquet(f"{data}/calendar"), as_of).select("Date", "HomeTeam", "AwayTeam")
    share = {r["column_name"]: r["coverage"] for r in cleaning.coverage(matches, list(cleaning.OPTIONAL)).collect()}
    report = counts | {"coverage": share, "violations": wide.count(), "first_violations": listed(wide, "MatchID", "column_name"), "gaps": gaps.count(), "first_gaps": listed(gaps, "Date", "HomeTeam")}
    store.write_document(spark, report, f"{data}/quality_report", overwrite=True)
    return features(spark, data, as_of)


def features(spark: SparkSession, data: str, as_of: date) -> int:
    """The training dataset, its fuzzy outputs and the ratings as they stand."""
    matches = spark.read.parquet(f"{data}/matches")
    rated = rating.elo(matches)
    sinks.write_table(pipelines.training_dataset(matches, rated), f"{data}/dataset")
    ratings = {r["team"]: r["rating"] for r in rating.latest_ratings(rated, 1).collect()}  # a row a team
    last = matches.agg(F.max(F.to_date("Date"))).first()[0]
    store.write_document(spark, {"as_of_date": str(last), "home_advantage": rating.HOME_ADVANTAGE, "k_factor": rating.K_FACTOR, "ratings": ratings}, f"{data}/ratings_latest", overwrite=True)
    return fuzzy_outputs(spark, data, as_of)


def fuzzy_outputs(spark: SparkSession, data: str, as_of: date) -> int:
    dataset = spark.read.parquet(f"{data}/dataset")
    sinks.write_table(fuzzy.infer(dataset), f"{data}/fuzzy_outputs")
    told = fuzzy.sanity(fuzzy.with_outcomes(dataset, spark.read.parquet(f"{data}/fuzzy_outputs"))).first().asDict()
    spread = metrics.quantiles(dataset, [c for c in ("HomeEloPre", "AwayEloPre", "Home_Result_L5", "Away_Result_L5", "Home_GF_L10", "Away_GF_L10", "Home_GA_L10", "Away_GA_L10") if c in dataset.columns])
    store.write_document(spark, told | {"inputs": {r["column_name"]: r["q"] for r in spread.collect()}}, f"{data}/fuzzy_report", overwrite=True)
    return 0


def train(spark: SparkSession, data: str, as_of: date, entries: dict[str, models.Entry] | None = None) -> int:
    """A new model version: members, weights, calibration, split, reports and card."""
    dataset = spark.read.parquet(f"{data}/dataset")
    season = current_season(as_of)
    for name, there in models.availability(entries or models.registry()):
        if not there:
            print(f"{name}: not available, left out")
    path, _ = store.next_path(spark, f"{data}/models")
    trained = pipelines.train(dataset, season, entries)
    split = splits.chronological_split(dataset, "SeasonStartYear", season).groupBy("split").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("SeasonStartYear")).alias("seasons")).collect()
    store.save(spark, trained, path, {r["split"]: r["n"] for r in split})
    store.write_document(spark, {r["split"]: {"rows": r["n"], "seasons": list(r["seasons"])} for r in split}, f"{path}/split_info")
    return 0


def _newest(spark: SparkSession, data: str) -> tuple[str, pipelines.Trained]:
    _, path = store.next_path(spark, f"{data}/models")
    if path is None:
        raise FileNotFoundError(f"no model version under {data}/models")
    return path.rsplit("model_", 1)[-1], store.load(spark, path)


def evaluate(spark: SparkSession, data: str, as_of: date, entries: dict[str, models.Entry] | None = None) -> int:
    """A walk-forward backtest with the newest version's weights and calibration."""
    version, trained = _newest(spark, data)
    tested = pipelines.backtest(spark.read.parquet(f"{data}/dataset"), trained, entries, current_season(as_of))
    pooled = {f"last_{r['last_n']}": r.asDict() for r in pipelines.pooled_report(tested).collect()}
    by_season = {str(r["season"]): r.asDict() for r in metrics.full_report(tested, ["season"]).collect()}  # a row a season
    store.write_document(spark, {"model_version": version, "pooled": pooled, "seasons": by_season}, f"{data}/backtest_report", overwrite=True)
    return 0


def predict_next(spark: SparkSession, data: str, as_of: date, season: int | None = None, round_number: int | None = None, refit: bool = True, entries: dict[str, models.Entry] | None = None) -> int:
    """Documents of a round, by default the next one to be played; 1 if there is none."""
    season = current_season(as_of) if season is None else season
    calendar, matches = spark.read.parquet(f"{data}/calendar"), spark.read.parquet(f"{data}/matches")
    if round_number is None:
        round_number = predict.next_round(calendar, season).first()[0]
    if round_number is None:
        print(f"no round of {season} is left to be played", file=sys.stderr)
        return 1
    version, trained = _newest(spark, data)
    if refit:
        trained = pipelines.production(trained, spark.read.parquet(f"{data}/dataset"), entries)
    documents = pipelines.predict_round(trained, calendar, matches, season, round_number, version)
    print(store.publish(documents, f"{data}/predictions", season, round_number, datetime.combine(as_of, datetime.now(UTC).time())))
    return 0


def collect(spark: SparkSession, data: str, as_of: date) -> int:
    """Appends predictions whose matches have a result to the history, each match once."""
    documents = readers.prediction_documents(spark, f"{data}/predictions/predictions_*.json", parent=True)
    rows = documents.select("prediction_time", "home_team", "away_team", F.to_date("date").alias("match_date"), "model_version", F.col("p_home_win").alias("p_h"), F.col("p_draw").alias("p_d"), F.col("p_away_win").alias("p_a"))
    m = spark.read.parquet(f"{data}/matches")
    actual = m.select(F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"), F.to_date("Date").alias("match_date"), F.col("FTHG").alias("actual_home"), F.col("FTAG").alias("actual_away"))
    history = Ledger(spark, f"{data}/history")
    history.append(lambda old: reconcile.score_history(reconcile.latest_per_match(rows), actual, old))
    r = reconcile.summary(history.read()).first()
    print(f"{r['n']} matches, hit rate {r['hit_rate'] or 0:.3f}, Brier {r['mean_brier'] or 0:.3f}, log loss {r['mean_log_loss'] or 0:.3f}")
    return 0


def report(spark: SparkSession, data: str, as_of: date, language: str = "en") -> int:
    """The newest history rows, names as ``language`` shows them, and the latest predictions' text blocks."""
    page = sinks.history_page(Ledger(spark, f"{data}/history").read())
    shown = store.read_or_none(spark, f"{data}/display_names")
    if shown is not None:
        page = localised(page, ["home_team", "away_team"], shown.filter(F.col("language") == language))
    sinks.write_documents(page, f"{data}/report/history")
    _, documents = store.latest(spark, f"{data}/predictions")
    sinks.write_documents(sinks.match_report(documents), f"{data}/report/latest")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pitchline")
    commands = p.add_subparsers(dest="command", required=True)
    run: dict[str, Callable[..., int]] = {"update": update, "features": features, "fuzzy": fuzzy_outputs, "train": train, "evaluate": evaluate, "predict": predict_next, "collect": collect, "report": report}
    for name, f in run.items():
        c = commands.add_parser(name, help=f.__doc__)
        c.add_argument("--data", required=True, help="folder of all tables")
        c.add_argument("--as-of", type=date.fromisoformat, default=datetime.now(UTC).date(), help="the day on which the command counts as run")
        if name == "update":
            c.add_argument("--seasons-back", type=int, default=9)
            c.add_argument("--force", action="store_true", help="fetch finished seasons again")
        elif name == "predict":
            c.add_argument("--season", type=int)
            c.add_argument("--round", type=int, dest="round_number")
            c.add_argument("--no-refit", action="store_false", dest="refit", help="predict with the version as it was trained")
        elif name == "report":
            c.add_argument("--language", default="en")
    args = vars(p.parse_args(argv))
    command = run[args.pop("command")]
    return command(SparkSession.builder.appName("pitchline").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.pop("data"), args.pop("as_of"), **args)


if __name__ == "__main__":
    sys.exit(main())
