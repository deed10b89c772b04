"""A season from the command line: update, train, evaluate, predict, collect, report."""

from __future__ import annotations

import json
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from pitchline import cli
from pitchline.functions.names import localised
from pitchline.plans import models, pipelines, store
from pitchline.plans.ledger import Ledger
from pitchline.sources import readers, sinks

TEAMS = ["Alba", "Boro", "Crest", "Dale", "Elms"]


def sources(played_until: date):
    """A fetch function for five seasons of made-up results and fixtures; matches after the day have no result."""
    rng = np.random.default_rng(3)
    strength = dict(zip(TEAMS, rng.normal(0, 0.4, len(TEAMS)), strict=True))
    files = {}
    for start in range(2019, 2024):
        results, fixtures = ["Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,AS"], ["Round Number,Date,Location,Home Team,Away Team"]
        pairs = [(h, a) for h in TEAMS for a in TEAMS if h != a]
        for k, (h, a) in enumerate(pairs):
            day = date(start, 8, 1) + timedelta(days=3 * k)
            hg, ag = int(rng.poisson(np.exp(0.25 + strength[h] - strength[a]))), int(rng.poisson(np.exp(strength[a] - strength[h])))
            if day <= played_until:
                results.append(f"{day:%d/%m/%Y},{h},{a},{hg},{ag},{'H' if hg > ag else 'A' if hg < ag else 'D'},{hg * 4 + 3},{ag * 4 + 2}")
            fixtures.append(f"{k // 2 + 1},{day:%d/%m/%Y} 15:00,Ground,{h},{a}")
        files[readers.results_url(start)], files[readers.fixtures_url(start)] = "\n".join(results), "\n".join(fixtures)
    return lambda url, name: files[url]


def test_a_season_from_update_to_report(spark, tmp_path):
    data, day = tmp_path.as_uri(), date(2023, 8, 20)
    entries = {k: v for k, v in models.registry(trees=5).items() if k in ("LogisticRegression", "RandomForest", "XGBoost")}
    assert cli.update(spark, data, day, 5, fetch=sources(day)) == 0
    quality = store.read_document(spark, f"{data}/quality_report")
    assert quality["rows_in"] == quality["rows_out"] == 4 * 20 + 7 and quality["gaps"] == 0 and quality["violations"] == len(quality["first_violations"])
    assert spark.read.parquet(f"{data}/provenance").count() == 10
    ratings = store.read_document(spark, f"{data}/ratings_latest")
    assert ratings["as_of_date"] == "2023-08-19" and set(ratings["ratings"]) == set(TEAMS)
    assert spark.read.parquet(f"{data}/fuzzy_outputs").count() == 87
    assert cli.train(spark, data, day, entries) == cli.train(spark, data, day, entries) == 0
    path, newest = store.next_path(spark, f"{data}/models")
    assert path.endswith("model_v003") and newest.endswith("model_v002")
    assert set(store.read_document(spark, f"{newest}/split_info")) == {"Train", "Validation", "Test"}
    trained = store.load(spark, newest)
    assert set(trained.classifiers) == {"LogisticRegression", "RandomForest"}
    dataset = spark.read.parquet(f"{data}/dataset")
    again = pipelines.train(dataset, 2023, entries)
    key = lambda df: sorted((r["MatchID"], round(r["p_h"], 9), round(r["p_d"], 9)) for r in df.collect())
    some = dataset.filter("SeasonStartYear = 2022")
    assert key(trained.blended(some)) == key(again.blended(some))  # what was loaded predicts like what was trained
    assert cli.evaluate(spark, data, day, {"LogisticRegression": entries["LogisticRegression"]}) == 0
    assert set(store.read_document(spark, f"{data}/backtest_report")["pooled"]) <= {"last_1", "last_2", "last_3"}
    assert cli.predict_next(spark, data, day, entries=entries) == 0
    meta, documents = store.latest(spark, f"{data}/predictions")
    assert (meta["season"], meta["round"]) == (2023, 4) and documents.count() == 1
    assert cli.predict_next(spark, data, day, season=2022) == 1  # all of it is played
    later = day + timedelta(days=9)
    assert cli.update(spark, data, later, 5, fetch=sources(later)) == 0
    assert cli.collect(spark, data, later) == cli.collect(spark, data, later) == 0
    assert Ledger(spark, f"{data}/history").read().count() == 1
    spark.createDataFrame([("Elms", "Ulmen", "de")], "name string, shown string, language string").write.parquet(f"{data}/display_names")
    assert cli.report(spark, data, later, "de") == 0
    assert len(spark.read.json(f"{data}/report/latest").first()["report"].splitlines()) == 5


def test_update_stops_at_a_failing_source(spark, tmp_path, capsys):
    def fetch(url, name):
        raise readers.DataSourceError(f"{name}: down")

    assert cli.update(spark, str(tmp_path), date(2023, 8, 20), 1, fetch=fetch) == 1
    assert "results 2023: down" in capsys.readouterr().err and not (tmp_path / "matches").exists()


def test_production_refits_on_all_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "fit_all", lambda rows, columns, label="FTR", entries=None: seen.update(n=rows.count(), entries=set(entries)) or {"a": 1})
    monkeypatch.setattr(pipelines.score_fit, "fit", lambda rows: "scores")
    rows = spark.createDataFrame([(1, "H"), (2, "D"), (3, None)], "x int, FTR string")
    old = pipelines.Trained(["x"], {"RandomForest": 0}, None, "weights", "platt", "reports")
    new = pipelines.production(old, rows)
    assert seen == {"n": 2, "entries": {"RandomForest"}} and (new.classifiers, new.scores, new.weights, new.platt) == ({"a": 1}, "scores", "weights", "platt")


def test_preparation_takes_nan_for_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    p = models.prepare(df, ["x"])
    assert p.median == {"x": 2.0} and p.mean == {"x": 2.0} and abs(p.deviation["x"] - 0.5**0.5) < 1e-12
    assert [r["features"][0] for r in p.apply(df, True).collect()][2:] == [0.0, 0.0]


def test_names_as_shown(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "team string, k int")
    names = spark.createDataFrame([("A", "Ah")], "name string, shown string")
    assert [r["team"] for r in localised(df, ["team"], names).orderBy("k").collect()] == ["Ah", "B", None]
    assert json.loads(df.select(F.to_json(F.struct("k"))).first()[0])


def test_reads_by_season_skip_other_folders(spark, tmp_path):
    path = str(tmp_path / "matches")
    df = spark.createDataFrame([(2019, 1), (2020, 2), (2020, 3)], "SeasonStartYear int, x int")
    sinks.write_seasons(df, path)
    sinks.write_seasons(df.filter("x = 2"), path)  # replaces its season, leaves the other
    one = spark.read.parquet(path).filter("SeasonStartYear = 2020")
    assert [r["x"] for r in one.collect()] == [2] and spark.read.parquet(path).count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(SeasonStartYear" in plan
    assert {f.rsplit("/", 2)[1] for f in one.select(F.input_file_name()).toPandas().iloc[:, 0]} == {"SeasonStartYear=2020"}
