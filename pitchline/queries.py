"""One query for each operator, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analogues import event_log, matches, probabilities, read
from .functions import calendar, names, probability
from .operators import cleaning, ensemble, form, fuzzy, metrics, predict, rating, reconcile, scores, splits
from .plans import models, pipelines, score_fit
from .plans.lineage import cut, table

#: Days before which a match counts as played, has a result on file, or an entry in the old history.
PLAYED_BEFORE, RESULTS_BEFORE, OLD_BEFORE = date(1997, 10, 1), date(2000, 3, 1), date(1996, 1, 1)

#: Days of a team's log that one task looks at, besides what it is lent.
PIECE_DAYS = 180

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def w1_rolling_form(s: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    p = form.Pieces(event_log(s, d), ["user_id"], order, PIECE_DAYS, days=form.CONGESTION_DAYS)
    out = p.settle(form.schedule_load(form.weighted_form(p.lent, p.keys, order, ("value",)), p.keys, "ts", order), "MatchesPlayedPrior")
    return rounded(out.select("event_id", "value_L3", "value_L5", "value_L10", F.col("MatchesPlayedPrior").alias("prior"), F.col("RestDays").alias("rest"), F.col("MatchesLast14Days").alias("last14")))


@query
def w5_venue_form(s: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    p = form.Pieces(event_log(s, d), ["user_id", "event_type"], order, PIECE_DAYS, rows=5)
    return rounded(p.settle(form.weighted_form(p.lent, p.keys, order, ("value",), (5,), prefix="venue_")).select("event_id", "venue_value_L5"))


@query
def fe_team_log(s: SparkSession, d: str) -> DataFrame:
    log = form.team_log(matches(s, d))
    return log.select(F.col("MatchID").alias("id"), F.col("Venue").alias("venue"), F.col("Team").alias("team"), F.col("Opponent").alias("opponent"), F.col("Result").alias("res"), F.col("GF").alias("gf"), F.col("GA").alias("ga"), F.col("ShotsF").alias("shots_f"), F.col("ShotsA").alias("shots_a"))


@query
def j1_training_features(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    wide = form.merge_sides(m.select("MatchID"), form.form_features(form.team_log(m), PIECE_DAYS))
    return rounded(wide.select(F.col("MatchID").alias("id"), *[F.col(f"{x}_{c}").alias(f"{x[0].lower()}_{c.lower()}") for x in ("Home", "Away") for c in ("Result_L5", "GF_L10", "GA_L3", "VenueGF_L5", "RestDays", "MatchesLast14Days")]))


@query
def j11_asof_snapshot(s: SparkSession, d: str) -> DataFrame:
    e = event_log(s, d)
    days = e.groupBy("user_id").agg(F.date_sub(F.max(F.to_date("ts")), 30).alias("early"), F.date_add(F.max(F.to_date("ts")), 1).alias("late"))
    up = days.select("user_id", F.explode(F.array("early", "late")).alias("as_of")).withColumn("k", F.concat_ws("|", "user_id", "as_of"))
    out = form.snapshot(up, e, "user_id", "as_of", "k", ("value",), (3, 10), order=("ts", "event_id"), date="ts", log_team="user_id", width=PIECE_DAYS)
    return rounded(out.select("user_id", "as_of", "value_L3", "value_L10", F.col("MatchesPlayedPrior").alias("prior"), F.col("RestDays").alias("rest"), F.col("MatchesLast14Days").alias("last14")))


@query
def w6_elo(s: SparkSession, d: str) -> DataFrame:
    r = rating.elo(matches(s, d))
    return rounded(r.select("id", "home_pre", "away_pre", "home_post", "away_post"))


@query
def w7_latest_ratings(s: SparkSession, d: str) -> DataFrame:
    return rating.last_ratings(matches(s, d), season=F.col("SeasonStartYear"), digits=1).select("team", "rating")


@query
def p3_season_calendar(s: SparkSession, d: str) -> DataFrame:
    start = calendar.season_start_year(F.col("o_orderdate"))
    return read(s, d, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start"), calendar.season_label(start).alias("label"))


@query
def p2_canonical_names(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation")
    alias = n.select(F.concat(F.substring("n_name", 1, 3), F.lit("_"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("canonical"), F.lit(1).alias("priority"))
    rows = read(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.substring("n_name", 1, 3), F.lit("_"), F.col("n_nationkey").cast("string"))).otherwise(F.concat("n_name", F.lit(" "))).alias("team"))
    return names.canonical_names(rows, "team", alias)


@query
def p4_lenient_dates(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).when(F.col("o_orderkey") % 4 == 2, F.lit("not a date")).otherwise(F.lit("31/02/2020"))
    return read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date(calendar.lenient_date(text)).alias("d"))


@query
def p7_result_and_key(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    return m.select(F.col("MatchID").alias("id"), probability.result(F.col("FTHG"), F.col("FTAG")).alias("result"), names.match_id(F.col("Date"), F.concat(F.lit("Team "), F.col("HomeTeam").cast("string")), F.concat(F.lit("Team "), F.col("AwayTeam").cast("string"))).alias("match_key"))


@query
def p8_range_violations(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d).select("MatchID", (F.col("FTHG") * 5).alias("FTHG"), "FTAG", (F.col("HS") * 3).alias("HS"), F.col("AS"))
    return cleaning.violations(m, "MatchID", cleaning.BOUNDS).withColumnRenamed("MatchID", "id")


@query
def l3_keep_first(s: SparkSession, d: str) -> DataFrame:
    li = read(s, d, "lineitem")
    return cleaning.keep_first(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in li.columns]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query
def a1_quality_counts(s: SparkSession, d: str) -> DataFrame:
    li = read(s, d, "lineitem")
    raw = li.select(F.to_date("l_shipdate").alias("Date"), F.col("l_orderkey").alias("HomeTeam"), F.col("l_linenumber").alias("AwayTeam"), F.when(F.col("l_partkey") % 10 != 0, (F.col("l_partkey") % 5).cast("int")).alias("FTHG"), (F.col("l_suppkey") % 4).cast("int").alias("FTAG"), F.when(F.col("l_returnflag") == "R", "H").otherwise("D").alias("FTR"))
    clean = cleaning.clean_results(raw, [F.col(c) for c in ("FTHG", "FTAG", "FTR")])
    return cleaning.quality_report(raw, clean)


@query
def a2_coverage(s: SparkSession, d: str) -> DataFrame:
    return cleaning.coverage(event_log(s, d), ["value", "ts", "absent"])


@query
def a3_matches_per_team(s: SparkSession, d: str) -> DataFrame:
    return matches(s, d).select(F.explode(F.array("HomeTeam", "AwayTeam")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))


@query
def a4_global_aggregates(s: SparkSession, d: str) -> DataFrame:
    return rounded(matches(s, d).agg(F.max("Date").alias("last"), F.avg("FTHG").alias("mean_home"), F.stddev_samp("HS").alias("sd_shots"), F.count_distinct("HomeTeam").alias("teams")))


@query
def a8_quantiles(s: SparkSession, d: str) -> DataFrame:
    q = metrics.quantiles(matches(s, d), ["HS", "AS"])
    return rounded(q.select("column_name", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))]))


def _calendar(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    return m.select(F.col("MatchID").alias("id"), "SeasonStartYear", (F.dayofyear("Date") % 38).alias("RoundNumber"), "Date", "HomeTeam", "AwayTeam")


@query
def j7_played(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    done = m.filter(F.col("Date") < PLAYED_BEFORE)
    key = lambda c: (F.col(c), F.col(c))
    return cleaning.mark_existing(_calendar(s, d), done, {"d": key("Date"), "h": key("HomeTeam"), "a": key("AwayTeam")}, "Played").select("id", F.col("Played").alias("played"))


def _played(s: SparkSession, d: str) -> DataFrame:
    return _calendar(s, d).withColumn("Played", F.col("Date") < PLAYED_BEFORE)


@query
def p13_schedule_gaps(s: SparkSession, d: str) -> DataFrame:
    return cleaning.schedule_gaps(_played(s, d), date(1998, 1, 1)).select("id")


@query
def a6_next_round(s: SparkSession, d: str) -> DataFrame:
    c = _played(s, d)
    both = predict.next_round(c, 1998).select(F.lit("smallest").alias("rule"), "next_round")
    return both.unionAll(predict.next_round_by_date(c, date(1998, 6, 1)).select(F.lit("by date"), "next_round"))


@query
def p14_upcoming_round(s: SparkSession, d: str) -> DataFrame:
    return predict.upcoming(_played(s, d), 1997, 5).select(F.col("MatchID").alias("match_key"), F.col("RoundNumber").alias("round"))


@query
def a9_full_report(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.full_report(probabilities(s, d), ["model"]))


@query
def a15_reliability(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_bins(probabilities(s, d), by=["model"]))


@query
def a17_baseline(s: SparkSession, d: str) -> DataFrame:
    p = probabilities(s, d)
    return rounded(metrics.full_report(metrics.frequency_baseline(p.filter("season < 1998"), p.filter("season >= 1998"))))


@query
def a18_softmax_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.log_loss_weights(metrics.full_report(probabilities(s, d), ["model"])))


def _members(s: SparkSession, d: str) -> DataFrame:
    p = probabilities(s, d).drop("model")
    turn = lambda n, a, b, c: p.select("id", F.lit(n).alias("model"), F.col(a).alias("p_h"), F.col(b).alias("p_d"), F.col(c).alias("p_a"))
    return turn("x", "p_h", "p_d", "p_a").unionAll(turn("y", "p_a", "p_h", "p_d")).unionAll(turn("z", "p_d", "p_a", "p_h"))


@query
def a19_blend(s: SparkSession, d: str) -> DataFrame:
    w = s.createDataFrame([("x", 0.5), ("y", 0.3), ("unused", 0.2)], "model string, weight double")
    return rounded(ensemble.blend(_members(s, d), w, "id"))


@query
def m10_platt_apply(s: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.Platt((4.0, 3.0, 5.0), (-2.0, -1.5, -2.5)).apply(probabilities(s, d).select("id", "p_h", "p_d", "p_a")))


@query
def m10_platt_fit(s: SparkSession, d: str) -> DataFrame:
    m = ensemble.fit_platt(probabilities(s, d))
    return rounded(s.createDataFrame([(k, a, b) for k, a, b in zip("HDA", m.slope, m.intercept, strict=True)], "outcome string, slope double, intercept double"), 4)


@query
def m10_platt_balance(s: SparkSession, d: str) -> DataFrame:
    """What a fitted logistic curve with an intercept must meet: its mean is the outcome's share."""
    p = probabilities(s, d)
    m = ensemble.fit_platt(p)
    curve = [1 / (1 + F.exp(-(F.col(c) * a + b))) for c, a, b in zip(("p_h", "p_d", "p_a"), m.slope, m.intercept, strict=True)]
    return rounded(p.agg(*[F.avg(c).alias(k) for k, c in zip("hda", curve, strict=True)]), 4)


@query
def m11_isotonic(s: SparkSession, d: str) -> DataFrame:
    """The isotonic curve's value at each probability of a home win."""
    p = probabilities(s, d)
    curve = ensemble.fit_isotonic(p, "p_h", "H")
    at = p.select("p_h").distinct()
    return rounded(at.join(curve, at["p_h"].between(curve["low"], curve["high"])).select(F.round("p_h", 6).alias("p_h"), "value", F.col("n").alias("block_rows")))


@query
def a20_pooled_seasons(s: SparkSession, d: str) -> DataFrame:
    p = probabilities(s, d)
    return rounded(metrics.full_report(splits.pooled_last(p, "season"), ["last_n"]).select("last_n", "n", "accuracy", "log_loss", "brier", "recall_h", "ece_home", "auc"))


@query
def a21_goals_sanity(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.goals_sanity(probabilities(s, d).withColumn("p_over", F.col("p_h") + F.col("p_d") / 2)))


@query
def a29_comparison(s: SparkSession, d: str) -> DataFrame:
    return metrics.comparison(metrics.full_report(probabilities(s, d), ["model"])).select("model", "n", "accuracy", "log_loss", "brier", "auc", "ece_home", "recall_h")


@query
def a30_beating_baseline(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.beating_baseline(metrics.full_report(probabilities(s, d), ["model"]), "m0"))


@query
def w12_walk_forward(s: SparkSession, d: str) -> DataFrame:
    return splits.walk_forward_folds(matches(s, d), "SeasonStartYear").withColumnRenamed("SeasonStartYear", "season")


@query
def w13_chronological_split(s: SparkSession, d: str) -> DataFrame:
    return splits.chronological_split(matches(s, d), "SeasonStartYear", current=2001).select(F.col("MatchID").alias("id"), "split")


_RATES = lambda: (F.lit(0.6) + F.col("HomeTeam") / 10.0, F.lit(0.5) + F.col("AwayTeam") / 12.0)


def _rated(s: SparkSession, d: str) -> DataFrame:
    h, a = _RATES()
    return matches(s, d).select(F.col("MatchID").alias("id"), h.alias("rate_h"), a.alias("rate_a"))


@query
def d1_expected_goals(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation")
    teams = n.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("team"), (F.col("n_nationkey") / 50.0 - 0.2).alias("attack"), (0.3 - F.col("n_nationkey") / 40.0).alias("defence"))
    return rounded(scores.with_rates(matches(s, d), teams, 0.1, 0.25).select(F.col("MatchID").alias("id"), "rate_h", "rate_a"))


@query
def d8_marginals(s: SparkSession, d: str) -> DataFrame:
    return rounded(scores.marginals(_rated(s, d), -0.08).drop("rate_h", "rate_a"))


@query
def d7_score_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(scores.score_matrix(_rated(s, d).select("rate_h", "rate_a").distinct().withColumn("k", F.format_string("%.4f|%.4f", "rate_h", "rate_a")), -0.08, "k").withColumnsRenamed({"h": "hg", "a": "ag"}))


@query
def w9_top_scores(s: SparkSession, d: str) -> DataFrame:
    t = scores.top_scores(_rated(s, d), -0.08)
    top = F.col("top_scorelines")
    return rounded(t.select("id", F.array_join(F.transform(top, lambda x: x["score"]), " ").alias("scores"), top[0]["probability"].alias("first"), top[4]["probability"].alias("fifth")))


@query
def a27_score_statistics(s: SparkSession, d: str) -> DataFrame:
    return rounded(scores.sufficient_statistics(matches(s, d), F.lit(date(2001, 8, 2))))


@query
def d4_score_fit(s: SparkSession, d: str) -> DataFrame:
    m = score_fit.fit(matches(s, d))
    return rounded(m.teams(s).withColumns({"advantage": F.lit(m.advantage), "base": F.lit(m.base), "rho": F.lit(m.rho)}), 4)


@query
def d4_score_balance(s: SparkSession, d: str) -> DataFrame:
    """What a fitted likelihood must meet: each team's weighted goals; where it misses them by a thousandth, its own figure."""
    m = matches(s, d)
    last = F.lit(m.agg(F.max("Date")).first()[0])
    w = scores.time_weight(F.col("Date"), last)
    side = lambda t, f, g: F.struct(F.col(t).alias("team"), (w * F.col(f)).alias("f"), (w * F.col(g)).alias("g"))
    own = m.select(F.explode(F.array(side("HomeTeam", "FTHG", "FTAG"), side("AwayTeam", "FTAG", "FTHG"))).alias("x")).groupBy("x.team").agg(F.sum("x.f").alias("f"), F.sum("x.g").alias("g"))
    met = lambda fitted, goals: F.when(F.abs(F.col(fitted) - F.col(goals)) <= 1e-3 * F.greatest(F.col(goals), F.lit(1.0)), F.col(goals)).otherwise(F.col(fitted))
    return rounded(score_fit.balance(m).join(own, "team").select("team", met("scored", "f").alias("scored"), met("conceded", "g").alias("conceded")), 4)


def _fuzzy_rows(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    i = F.col("MatchID")
    n = lambda c, k: F.when(i % k != 0, c)
    return m.select(
        i.alias("id"), n(i % 101 / 100.0, 13).alias("Home_Result_L5"), n(i % 89 / 88.0, 17).alias("Away_Result_L5"), n(i % 46 / 10.0, 11).alias("Home_GF_L10"), n(i % 43 / 10.0, 19).alias("Away_GF_L10"),
        n(i % 41 / 10.0, 23).alias("Home_GA_L10"), n(i % 37 / 10.0, 29).alias("Away_GA_L10"), n(i % 51 / 50.0, 7).alias("Home_VenueResult_L5"), n(i % 21, 31).alias("Home_RestDays"), n(i % 19, 37).alias("Away_RestDays"),
        n(i % 6, 41).alias("Home_MatchesLast14Days"), n(i % 5, 43).alias("Away_MatchesLast14Days"), (1200 + i % 750).cast("double").alias("HomeEloPre"), (1200 + i % 733).cast("double").alias("AwayEloPre"),
    )


@query
def f10_fuzzy_inference(s: SparkSession, d: str) -> DataFrame:
    return rounded(fuzzy.infer(_fuzzy_rows(s, d), "id"), 9)


@query
def j4_inference_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Inference joined with what happened, as the figures that tell how far it tells matches apart."""
    outputs = rounded(fuzzy.infer(_fuzzy_rows(s, d), "id"), 9)
    return rounded(fuzzy.sanity(fuzzy.with_outcomes(matches(s, d).withColumnRenamed("MatchID", "id"), outputs, "id")))


@query
def m1_logistic_balance(s: SparkSession, d: str) -> DataFrame:
    """What a fitted multinomial logistic regression must meet: its mean probabilities are the outcomes' shares; where it misses by a thousandth, its own."""
    split = splits.chronological_split(pipelines.training_dataset(matches(s, d), width=PIECE_DAYS), "SeasonStartYear", current=2001)
    rows = table(split.filter("split = 'Train'"))
    entry = {"LogisticRegression": models.registry()["LogisticRegression"]}
    fitted = models.fit_all(rows, models.with_values(rows, models.feature_columns(rows)), entries=entry)["LogisticRegression"]
    mean = fitted.probabilities(rows, "MatchID").join(rows.select("MatchID", "FTR"), "MatchID").agg(*[x for k, p in zip("HDA", ("p_h", "p_d", "p_a"), strict=True) for x in (F.avg(p).alias(p), F.avg((F.col("FTR") == k).cast("double")).alias(k))])
    return rounded(mean.select(*[F.when(F.abs(F.col(p) - F.col(k)) < 1e-3, F.col(k)).otherwise(F.col(p)).alias(p) for k, p in zip("HDA", ("p_h", "p_d", "p_a"), strict=True)]))


@query
def f5_fatigue(s: SparkSession, d: str) -> DataFrame:
    r = _fuzzy_rows(s, d)
    return rounded(r.select("id", fuzzy.fatigue(F.col("Home_RestDays"), F.col("Home_MatchesLast14Days")).alias("home"), fuzzy.fatigue(F.col("Away_RestDays"), F.col("Away_MatchesLast14Days")).alias("away")))


@query
def w10_influences(s: SparkSession, d: str) -> DataFrame:
    r = _fuzzy_rows(s, d).withColumn("EloDiffPre", F.col("HomeEloPre") - F.col("AwayEloPre")).withColumnRenamed("Home_VenueResult_L5", "_v")
    f = predict.influences(r, "id", {"Home_Result_L5": 0.2, "Away_Result_L5": 0.1, "Home_GA_L10": 0.3, "Away_GA_L10": 0.1, "Home_RestDays": 0.05, "EloDiffPre": 0.4}, {"Home_Result_L5": 0.25, "Home_GA_L10": 0.5, "EloDiffPre": 150.0}, 2)
    return rounded(f.select("id", F.posexplode("factors").alias("place", "x")).select("id", "place", F.col("x.label").alias("label"), F.col("x.score").alias("score"), F.col("x.favors").alias("favors")))


@query
def w11_confidence(s: SparkSession, d: str) -> DataFrame:
    p = [F.col(c) for c in ("p_h", "p_d", "p_a")]
    return probabilities(s, d).select("id", probability.argmax_label(*p).alias("predicted"), probability.confidence(*p).alias("confidence"))


@query
def a24_confidence_counts(s: SparkSession, d: str) -> DataFrame:
    return predict.confidence_counts(w11_confidence(s, d))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    p = probabilities(s, d).join(matches(s, d).select(F.col("MatchID").alias("id"), "HomeTeam", "AwayTeam", "Date"), "id")
    return p.select(F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"), F.date_trunc("month", "Date").cast("date").alias("match_date"), (F.col("id") % 50).alias("prediction_time"), F.format_string("v%09d", "id").alias("model_version"), "p_h", "p_d", "p_a")


def _actual(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d).select(F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"), F.date_trunc("month", "Date").cast("date").alias("match_date"), "FTHG", "FTAG", "MatchID")
    return m.filter(F.col("Date") < RESULTS_BEFORE).groupBy(*reconcile.KEY).agg(F.min_by("FTHG", "MatchID").alias("actual_home"), F.min_by("FTAG", "MatchID").alias("actual_away"))


@query
def a26_latest_prediction(s: SparkSession, d: str) -> DataFrame:
    return rounded(reconcile.latest_per_match(_predictions(s, d)))


@query
def j9_reconciled_history(s: SparkSession, d: str) -> DataFrame:
    old = _predictions(s, d).filter(F.col("match_date") < OLD_BEFORE)
    return rounded(reconcile.score_history(reconcile.latest_per_match(_predictions(s, d)), _actual(s, d), old).drop("p_h", "p_d", "p_a"), 3)


@query
def a22_history_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(reconcile.summary(reconcile.score_history(reconcile.latest_per_match(_predictions(s, d)), _actual(s, d))), 3)


@query
def j8_pending(s: SparkSession, d: str) -> DataFrame:
    return reconcile.pending(reconcile.latest_per_match(_predictions(s, d)), _actual(s, d))


@query
def l4_newest_rows(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id")


@query
def s12_latest_version(s: SparkSession, d: str) -> DataFrame:
    paths = read(s, d, "orders").select(F.concat(F.lit("models/model_v"), F.lpad((F.col("o_orderkey") % 1200).cast("string"), 3, "0").alias("v")).alias("path"))
    long = paths.unionAll(s.createDataFrame([("models/model_v1205",), ("models/readme",)], "path string"))
    return predict.latest_version(long)


@query
def u2_set_operations(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    mean = lambda c, g, least: m.groupBy(F.col(c).alias("team"), "SeasonStartYear").agg(F.avg(g).alias("g")).filter(F.col("g") > least).drop("g")
    home, away = mean("HomeTeam", "FTHG", 2.0), mean("AwayTeam", "FTAG", 1.5)
    tag = lambda df, n: df.select(F.lit(n).alias("op"), "team", F.col("SeasonStartYear").alias("season"))
    return tag(home.union(away).distinct(), "union").unionAll(tag(home.subtract(away), "difference")).unionAll(tag(home.intersect(away), "intersection"))


@query
def w8_time_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(matches(s, d).select(F.col("MatchID").alias("id"), scores.time_weight(F.col("Date"), F.lit(date(1999, 1, 1))).alias("w")))


@query
def a25_extremes_by_key(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.full_report(probabilities(s, d), ["model"]).agg(F.min_by("model", "log_loss").alias("best"), F.max_by("model", "accuracy").alias("most_accurate"), F.min("log_loss").alias("log_loss")))


@query
def j12_serving_features(s: SparkSession, d: str) -> DataFrame:
    m = matches(s, d)
    history = m.filter("SeasonStartYear < 2000")
    up = m.filter("SeasonStartYear = 2000").select("MatchID", "Date", "HomeTeam", "AwayTeam")
    f = form.features_for_upcoming(up, form.team_log(history), rating.latest_ratings(rating.elo(history)).withColumn("team", F.col("team")), width=PIECE_DAYS)
    return rounded(f.select(F.col("MatchID").alias("id"), "Home_GF_L5", "Away_Result_L10", "Home_VenueGA_L5", "Away_VenueResult_L5", "Home_RestDays", "Away_MatchesPlayedPrior", "HomeEloPre", "AwayEloPre"))


@query
def m4_trained_members(s: SparkSession, d: str) -> DataFrame:
    data = pipelines.training_dataset(matches(s, d), width=PIECE_DAYS)
    return rounded(pipelines.train(data, current=2001).reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


