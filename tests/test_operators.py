"""Worked cases, edge cases and properties of the operators."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.functions import calendar, names, probability
from pitchline.operators import cleaning, ensemble, form, fuzzy, metrics, predict, rating, reconcile, scores, splits
from pitchline.plans import models, pipelines, score_fit
from pitchline.plans.lineage import cut
from pitchline.sources import readers, sinks
from pitchline.streaming.reconcile import reconcile_stream


def league(spark, seasons=5, teams=8, seed=1):
    rng = np.random.default_rng(seed)
    strength, rows = rng.normal(0, 0.4, teams), []
    for y in range(2015, 2015 + seasons):
        day = 0
        for h in range(teams):
            for a in range(teams):
                if h != a:
                    day += 3
                    hg, ag = (int(rng.poisson(np.exp(0.25 + strength[h] - strength[a]))), int(rng.poisson(np.exp(strength[a] - strength[h]))))
                    d = date(y, 8, 1).toordinal() + day
                    rows.append((date.fromordinal(d), f"T{h}", f"T{a}", hg, ag, "H" if hg > ag else "A" if hg < ag else "D", y, f"{y}-{(y + 1) % 100:02d}", hg * 4 + 3, ag * 4 + 2))
    df = spark.createDataFrame(rows, "Date date, HomeTeam string, AwayTeam string, FTHG int, FTAG int, FTR string, SeasonStartYear int, Season string, HS int, AS int")
    return df.withColumn("MatchID", names.match_id(F.col("Date"), F.col("HomeTeam"), F.col("AwayTeam")))


def test_calendar_and_names(spark):
    assert calendar.season_code(2026) == "2627" and calendar.season_code(1999) == "9900" and calendar.season_slug(2026) == "epl-2026"
    assert calendar.current_season(date(2026, 6, 30)) == 2025 and calendar.current_season(date(2026, 7, 1)) == 2026
    r = spark.range(1).select(calendar.season_label(F.lit(1999)).alias("a"), names.known_name(F.lit(" Man Utd ")).alias("b"), names.known_name(F.lit("Leeds ")).alias("c"), names.known_name(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(r) == ("1999-00", "Man United", "Leeds", None)
    df = spark.createDataFrame([("X",), ("Y",), (None,)], "team string")
    assert [r[0] for r in names.unknown_names(df, "team", spark.createDataFrame([("X",)], "name string")).collect()] == ["Y"]


def test_rolling_form_by_hand_and_without_leak(spark):
    rows = [("a", i, float(v) if v is not None else None) for i, v in enumerate([2, 0, 1, None, 3, 5, 1])]
    df = spark.createDataFrame(rows, "t string, i int, g double")
    out = {r["i"]: r for r in form.weighted_form(df, ["t"], ["i"], ("g",)).collect()}
    assert out[0]["g_L5"] is None and out[1]["g_L5"] == 2.0
    prev = [0, 1, None, 3, 5]
    w = [0.85 ** (4 - k) for k in range(5)]
    assert abs(out[6]["g_L5"] - sum(x * v for x, v in zip(w, prev, strict=True) if v is not None) / sum(x for x, v in zip(w, prev, strict=True) if v is not None)) < 1e-12
    more = df.unionAll(spark.createDataFrame([("a", 99, 50.0)], df.schema))
    later = {r["i"]: r for r in form.weighted_form(more, ["t"], ["i"], ("g",)).collect()}
    assert all(later[i] == out[i] for i in out)


def test_load_counts_rows_of_one_day(spark):
    days = [date(2020, 1, 1), date(2020, 1, 1), date(2020, 1, 10), date(2020, 1, 15), date(2020, 1, 24)]
    df = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)], "t string, Date date, i int")
    got = {r["i"]: (r["MatchesPlayedPrior"], r["RestDays"], r["MatchesLast14Days"]) for r in form.schedule_load(df, ["t"], "Date", ["Date", "i"]).collect()}
    assert got == {0: (0, None, 0), 1: (1, 0, 1), 2: (2, 9, 2), 3: (3, 5, 1), 4: (4, 9, 1)}


def test_training_and_serving_features_agree(spark):
    m = league(spark, 2)
    cut = m.agg(F.max("Date")).first()[0]
    last = m.filter(F.col("Date") == F.lit(cut))
    data = pipelines.training_dataset(m).filter(F.col("Date") == F.lit(cut)).first()
    history = m.filter(F.col("Date") < F.lit(cut))
    served = form.features_for_upcoming(last.select("MatchID", "Date", "HomeTeam", "AwayTeam"), form.team_log(history), rating.latest_ratings(rating.elo(history))).first()
    for c in [f"{s}_{n}" for s in ("Home", "Away") for n in form.feature_names()] + ["HomeEloPre", "AwayEloPre", "EloDiffPre"]:
        a, b = data[c], served[c]
        assert (a is None and b is None) or abs(a - b) < 1e-9, c
    assert not {"HS", "AS", "Home_GF", "Away_GA"} & set(data.asDict())


def test_form_windows_share_one_exchange(spark):
    log = form.team_log(league(spark, 1))
    plan = form.weighted_form(log, ["Team"], ["Date", "MatchID"], form.METRICS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "collect_list" not in plan


def test_elo_conserves_points_and_follows_a_plain_fold(spark):
    m = league(spark, 2)
    got = {r["id"]: r for r in rating.elo(m).collect()}
    state = {}
    for r in m.orderBy("Date", "MatchID").collect():
        h, a = state.get(r["HomeTeam"], 1500.0), state.get(r["AwayTeam"], 1500.0)
        g = got[r["MatchID"]]
        assert abs(g["home_pre"] - h) < 1e-9 and abs(g["away_pre"] - a) < 1e-9
        gap = abs(r["FTHG"] - r["FTAG"])
        k = 20 * (1 if gap <= 1 else 1.5 if gap == 2 else (11 + gap) / 8) * ((r["FTHG"] > r["FTAG"]) + 0.5 * (r["FTHG"] == r["FTAG"]) - 1 / (1 + 10 ** (-(h + 100 - a) / 400)))
        state[r["HomeTeam"]], state[r["AwayTeam"]] = h + k, a - k
    last = {r["team"]: r["rating"] for r in rating.latest_ratings(rating.elo(m)).collect()}
    assert abs(sum(last.values()) - 1500 * 8) < 1e-6 and all(abs(last[t] - state[t]) < 1e-9 for t in last)
    e = spark.range(1).select(rating.expected(F.lit(1500.0), F.lit(1600.0)).alias("e"), rating.margin(F.lit(-4)).alias("m")).first()
    assert e["e"] == 0.5 and e["m"] == 15 / 8


def test_fuzzy_worked_case_and_defaults(spark):
    extreme = dict(id=1, Home_Result_L5=1.0, Away_Result_L5=0.0, Home_GF_L10=2.5, Away_GF_L10=0.5, Home_GA_L10=0.3, Away_GA_L10=2.5, Home_VenueResult_L5=1.0, Home_RestDays=10, Away_RestDays=10, Home_MatchesLast14Days=1, Away_MatchesLast14Days=1, HomeEloPre=1900.0, AwayEloPre=1250.0)
    r = fuzzy.infer(spark.createDataFrame([extreme]), "id").first()
    assert [round(r[f"Fuzzy_P_{k}"], 3) for k in ("HomeWin", "Draw", "AwayWin")] == [0.643, 0.178, 0.178]
    assert len(fuzzy.rules()) == 46 and sum(map(len, fuzzy.TERMS.values())) == 30
    bare = fuzzy.infer(spark.createDataFrame([(1,)], "id int"), "id").first()
    assert abs(sum(bare[f"Fuzzy_P_{k}"] for k in ("HomeWin", "Draw", "AwayWin")) - 1) < 1e-12
    f = spark.range(1).select(fuzzy.fatigue(F.lit(None).cast("int"), F.lit(0)).alias("a"), fuzzy.fatigue(F.lit(20), F.lit(9)).alias("b"), fuzzy.fatigue(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("c")).first()
    assert np.allclose(tuple(f), (0.18, 0.4, 0.26))


def test_scores_sum_to_one_and_fit_recovers_rates(spark):
    m = league(spark, 5)
    model = score_fit.fit(m, half_life=1e9)
    rows = scores.with_rates(m, model.teams(spark), model.base, model.advantage)
    p = scores.marginals(rows, model.rho).collect()
    assert all(abs(r["P_HomeWin"] + r["P_Draw"] + r["P_AwayWin"] - 1) < 1e-9 for r in p)
    assert abs(np.mean([r["rate_h"] for r in p]) - np.mean([r["FTHG"] for r in p])) < 0.15
    unknown = scores.with_rates(spark.createDataFrame([("?", "!")], "HomeTeam string, AwayTeam string"), model.teams(spark), 0.0, 0.3).first()
    assert abs(unknown["rate_h"] - np.exp(0.3)) < 1e-12 and unknown["rate_a"] == 1.0
    empty = score_fit.fit(m.limit(0), as_of=F.lit(date(2020, 1, 1)))
    assert empty.attack == {}


def test_score_gradient_is_right_and_the_minimum_is_one():
    rng = np.random.default_rng(3)
    n, k = 4, 60
    h, a = rng.integers(0, n, k), rng.integers(0, n, k)
    hg, ag, w = rng.integers(0, 4, k).astype(float), rng.integers(0, 3, k).astype(float), rng.random(k)
    x = rng.normal(0, 0.2, 2 * n + 3) * np.append(np.ones(2 * n), [1, 1, 0.2])
    f = lambda v: score_fit.objective(v, h, a, hg, ag, w, n)
    _, g = f(x)
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = 1e-6
        assert abs((f(x + e)[0] - f(x - e)[0]) / 2e-6 - g[i]) < 1e-5
    low, high = np.full(len(x), -3.0), np.full(len(x), 3.0)
    low[-1], high[-1] = -0.3, 0.3
    best = score_fit.minimise(f, x, low, high)
    value, grad = f(best)
    free = (best > low) & (best < high)
    assert np.abs(grad[free]).max() < 1e-3
    assert all(f(np.clip(best + rng.normal(0, 0.01, len(x)), low, high))[0] >= value - 1e-9 for _ in range(50))


def test_metrics_edges(spark):
    rows = [("H", 1.0, 0.0, 0.0), ("D", 0.3, 0.3, 0.4), ("H", 0.5, 0.5, 0.0), ("H", 0.1, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "y string, p_h double, p_d double, p_a double")
    r = metrics.full_report(df).first()
    assert r["n"] == 4 and r["accuracy"] == 0.5 and r["recall_a"] is None and r["recall_d"] == 0.0 and r["auc"] is None
    bins = {b["bin"]: b["n"] for b in metrics.calibration_bins(df).collect()}
    assert bins == {9: 1, 3: 1, 5: 1, 1: 1}
    assert metrics.full_report(df.limit(0)).first()["n"] == 0


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 20, 300) / 20, rng.random(300) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y, strict=True)], "s double, hit boolean")
    got = metrics.auc(df, "s", F.col("hit")).first()["auc"]
    pos, neg = s[y], s[~y]
    assert abs(got - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 1e-12


def test_reconciliation_worked_case_and_idempotence(spark):
    latest = spark.createDataFrame([("A", "B", "2026-10-01", 5, "v1", 0.229, 0.241, 0.530)], "home_team string, away_team string, match_date string, prediction_time int, model_version string, p_h double, p_d double, p_a double")
    actual = spark.createDataFrame([("A", "B", "2026-10-01", 1, 2)], "home_team string, away_team string, match_date string, actual_home int, actual_away int")
    new = reconcile.score_history(latest, actual)
    r = new.first()
    assert (r["correct"], r["brier_score"], r["log_loss"], r["actual_result"]) == (True, 0.3314, 0.6349, "A")
    assert reconcile.score_history(latest, actual, new).count() == 0
    late = latest.withColumn("kickoff", F.lit(4))
    assert reconcile.latest_per_match(late, "kickoff").count() == 0


def test_stream_adds_each_match_once(spark, tmp_path):
    schema = "home_team string, away_team string, match_date string, prediction_time int, model_version string, p_h double, p_d double, p_a double"
    rows = [("A", "B", "d1", 1, "v1", 0.5, 0.3, 0.2), ("A", "B", "d1", 2, "v2", 0.2, 0.3, 0.5), ("C", "D", "d1", 1, "v1", 0.5, 0.3, 0.2)]
    results = lambda s: s.createDataFrame([("A", "B", "d1", 0, 1)], "home_team string, away_team string, match_date string, actual_home int, actual_away int")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(src)
    for k in range(2):
        q = reconcile_stream(spark.readStream.schema(schema).parquet(src), results, out, str(tmp_path / f"cp{k}"))
        assert q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert [(r["model_version"], r["correct"]) for r in got] == [("v2", True)]


def test_splits_and_rounds(spark):
    df = spark.createDataFrame([(y,) for y in (2018, 2019, 2020, 2021, 2022)], "s int")
    got = {r["s"]: r["split"] for r in splits.chronological_split(df, "s", current=2022).collect()}
    assert got == {2018: "Train", 2019: "Train", 2020: "Validation", 2021: "Test"}
    with pytest.raises(ValueError, match="too few"):
        splits.chronological_split(df.limit(2), "s")
    cal = spark.createDataFrame([(2020, 3, datetime(2020, 9, 1, 15), "A", "B", False), (2020, 2, datetime(2020, 12, 1, 15), "C", "D", False), (2020, 2, datetime(2020, 8, 1), "E", "F", True)], "SeasonStartYear int, RoundNumber int, Date timestamp_ntz, HomeTeam string, AwayTeam string, Played boolean")
    assert predict.next_round(cal).first()[0] == 2 and predict.next_round_by_date(cal, date(2020, 8, 15)).first()[0] == 3
    assert predict.upcoming(cal, 2020, 2).count() == 1 and predict.upcoming(cal, 2020, 2, include_played=True).count() == 2
    assert predict.next_round(cal.filter("Played")).first()[0] is None


def test_platt_equals_a_newton_fit(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([2, 1, 1.5], 400)
    y = ["HDA"[rng.choice(3, p=q)] for q in p]
    df = spark.createDataFrame([(*map(float, q), k) for q, k in zip(p, y, strict=True)], "p_h double, p_d double, p_a double, y string")
    m = ensemble.fit_platt(df)
    for i, k in enumerate("HDA"):
        z, t = np.stack([p[:, i], np.ones(400)], axis=1), np.array([c == k for c in y], float)
        w = np.zeros(2)
        for _ in range(60):
            q = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag([1.0, 0]), z.T @ (t - q) - [w[0], 0])
        assert abs(m.slope[i] - w[0]) < 1e-6 and abs(m.intercept[i] - w[1]) < 1e-6
    assert abs(sum(m.apply(df).select("p_h", "p_d", "p_a").first()) - 1) < 1e-9


def test_cleaning_contracts(spark):
    with pytest.raises(ValueError, match="FTR"):
        cleaning.require_columns(spark.createDataFrame([(1,)], "Date int"), cleaning.CORE, "x")
    rows = [("2020-01-01", "A", "B", 2, 1, "D", 99), ("2020-01-01", "A", "B", 0, 0, "D", 1), ("2020-01-02", "A", None, 1, 1, "D", 1)]
    raw = spark.createDataFrame(rows, "Date string, HomeTeam string, AwayTeam string, FTHG int, FTAG int, FTR string, HS int").withColumn("Date", F.to_date("Date"))
    clean = cleaning.clean_results(raw, [F.col("HS").desc()])
    assert [(r["FTR"], r["MatchID"]) for r in clean.collect()] == [("H", "20200101_A_B")]
    q = cleaning.quality_report(raw, clean).first()
    assert (q["rows_in"], q["missing_core"], q["result_fixes"], q["rows_out"], q["duplicates"]) == (3, 1, 1, 1, 1)
    assert [tuple(r) for r in cleaning.violations(clean, "MatchID", cleaning.BOUNDS).collect()] == [("20200101_A_B", "HS", 99.0)]


def test_sources_and_sinks(spark, tmp_path):
    class Answer:
        status = 200

        def __init__(self, text):
            self.text = text

        def read(self):
            return self.text.encode("utf-8-sig")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    good = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS\n17/08/2019,Man Utd,Leeds ,2,x,H,5\nbad,Spurs,Hull,1,1,D,\n"
    assert readers.fetch_csv("u", "n", lambda u, timeout: Answer(good)) == good
    for bad in ("", "a,b\n1,2\n"):
        with pytest.raises(readers.DataSourceError):
            readers.fetch_csv("u", "n", lambda u, timeout, bad=bad: Answer(bad))
    landed = {}
    done, errors = readers.update_all(2020, 2, lambda k, y, t: landed.__setitem__((k, y), t), lambda k, y: y == 2019, fetch=lambda u, n: good if "results" in n else (_ for _ in ()).throw(readers.DataSourceError(n)))
    assert list(landed) == [("results", 2020)] and done[0]["row_count"] == 2 and errors == ["fixtures 2019", "fixtures 2020"]
    (tmp_path / "results_2019.csv").write_text(good)
    (tmp_path / "results_2018.csv").write_text(good)
    df = readers.results(spark, str(tmp_path / "results_*.csv"), since=2019)
    got = sorted((str(r["Date"]), r["HomeTeam"], r["AwayTeam"], r["FTHG"], r["FTAG"], r["Season"]) for r in df.collect())
    assert got == [("2019-08-17", "Man United", "Leeds", 2, None, "2019-20"), ("None", "Tottenham", "Hull", 1, 1, "2019-20")]
    out = str(tmp_path / "t")
    sinks.write_seasons(df.drop("_file"), out)
    sinks.write_seasons(df.drop("_file").limit(1), out)
    assert spark.read.parquet(out).count() == 1
    sinks.append_new(df.select("HomeTeam"), None, str(tmp_path / "h"), ["HomeTeam"])
    sinks.append_new(df.select("HomeTeam"), spark.read.parquet(str(tmp_path / "h")), str(tmp_path / "h"), ["HomeTeam"])
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "predictions_2026_R9_20261103_073305.json").write_text('{"home": "A", "x": 1}')
    (tmp_path / "p" / "predictions_2026_R9_20261104_073305.json").write_text("{broken")
    (tmp_path / "p" / "other.json").write_text('{"home": "B", "x": 2}')
    docs = readers.prediction_documents(spark, str(tmp_path / "p"), "home string, x int").collect()
    assert [(r["home"], str(r["prediction_time"])) for r in docs] == [("A", "2026-11-03 07:33:05")]


def test_train_predict_and_backtest(spark):
    m = league(spark, 5, 5)
    entries = {k: v for k, v in models.registry(trees=5, boosts=2).items() if k in ("LogisticRegression", "RandomForest", "XGBoost")}
    assert dict(models.availability(entries))["XGBoost"] is False
    data = cut(pipelines.training_dataset(m))
    t = pipelines.train(data, entries=entries)
    assert {r["model"] for r in t.reports.collect()} == {"Poisson", "Fuzzy", "LogisticRegression", "RandomForest"}
    assert abs(t.weights.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    last = m.filter("SeasonStartYear = 2019").withColumns({"RoundNumber": F.lit(1), "Played": F.lit(False)}).limit(3)
    docs = pipelines.predict_round(t, last, m.filter("SeasonStartYear < 2019"), 2019, 1, "v001").collect()
    assert len(docs) == 3
    for d in docs:
        assert abs(d["p_home_win"] + d["p_draw"] + d["p_away_win"] - 1) < 1e-6 and len(d["top_scorelines"]) == 5 and d["confidence"] in ("High", "Medium", "Low")
    b = pipelines.backtest(data, t, {"LogisticRegression": entries["LogisticRegression"]})
    assert {r["last_n"]: r["n"] for r in pipelines.pooled_report(b, 2).collect()} == {1: 20, 2: 40}
    assert probability.OUTCOMES == ("H", "D", "A")


def test_trained_members_use_the_whole_registry(spark, monkeypatch):
    from pitchline import queries

    class Seen(Exception):
        pass

    def fit_all(train, columns, label="FTR", entries=None):
        raise Seen(entries)

    monkeypatch.setattr(models, "fit_all", fit_all)
    with pytest.raises(Seen) as seen:
        queries.queries()["m4_trained_members"](spark, "/root/testdata/sf0.001")
    used, whole = seen.value.args[0] or models.registry(), models.registry()
    available = [k for k, e in whole.items() if e.available]
    assert [k for k, e in used.items() if e.available] == available and {"BoostedTrees", "BoostedTreesShallow"} <= set(available)
    assert used["RandomForest"].build(9).getNumTrees() == whole["RandomForest"].build(9).getNumTrees() == 400


def test_influences_of_equal_size_go_by_label(spark):
    # 0.4 * 0.1 and 0.4 / 150 * 15 are equal but for their last bits
    df = spark.createDataFrame([(0, 2.2, 2.3, 15.0), (1, 2.8, 2.7, 15.0)], "id long, Home_GA_L10 double, Away_GA_L10 double, EloDiffPre double")
    got = predict.influences(df, "id", {"Home_GA_L10": 0.3, "Away_GA_L10": 0.1, "EloDiffPre": 0.4}, {"Home_GA_L10": 0.5, "EloDiffPre": 150.0}).collect()
    assert [[x["label"] for x in r["factors"]] for r in got] == [["Goals conceded (last 10)", "Rating difference"]] * 2


def test_entries_are_fitted_side_by_side(spark):
    import threading

    both = threading.Barrier(2, timeout=30)

    class Waits:
        def fit(self, df):
            both.wait()
            return df.rdd.getNumPartitions()

    train = spark.createDataFrame([(i, float(i), "HDA"[i % 3]) for i in range(30)], "MatchID long, x double, FTR string").repartition(4)
    got = models.fit_all(train, ["x"], entries={k: models.Entry(lambda n: Waits(), False) for k in ("a", "b")})
    assert {k: f.model for k, f in got.items()} == {"a": 1, "b": 1}
