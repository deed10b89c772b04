"""Logs cut in pieces with loans give the rows of whole windows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitchline.operators import form

SCHEMA = "Team string, Venue string, Date date, MatchID long, g double, piece int, __piece int"


@pytest.fixture(scope="module")
def log(spark):
    """A busy team (several rows a day), idle ones with gaps of years, repeated and missing dates, a null team."""
    rng, rows = random.Random(8), []
    spans = {"busy": 120, "idle": 3000, "rare": 9000, None: 400}
    for team, span in spans.items():
        for _ in range(400 if team == "busy" else 60):
            day = None if rng.random() < 0.03 else date(2000, 1, 1) + timedelta(days=rng.randrange(span))
            rows.append((team, rng.choice("HA"), day, len(rows), None if rng.random() < 0.1 else float(rng.randint(0, 6)), 1, 2))
    rows.append(("once", "H", date(2001, 5, 5), len(rows), 1.0, 1, 2))
    return spark.createDataFrame(rows, SCHEMA)


def features(df, keys):
    order = ["Date", "MatchID"]
    return form.schedule_load(form.weighted_form(df, keys, order, ("g",)), keys, "Date", order)


@pytest.mark.parametrize("width", [14, 30, 365, 100_000])
def test_pieces_equal_whole_windows(log, width):
    order = ["Date", "MatchID"]
    p = form.Pieces(log, ["Team"], order, width, days=14)
    got = p.settle(features(p.lent, p.keys), "MatchesPlayedPrior")
    want = features(log, ["Team"])
    assert got.columns == want.columns
    key = lambda df: sorted(((r["MatchID"], *(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[5:])) for r in df.collect()), key=lambda r: r[0])
    assert key(got) == key(want)


def test_a_hot_team_is_the_work_of_many_tasks(spark, log):
    p = form.Pieces(log, ["Team"], ["Date", "MatchID"], 14, days=14)
    size = {(r[0], r[1]): r[2] for r in p.lent.groupBy(*p.keys).count().collect()}
    of = [n for (team, _), n in size.items() if team == "busy"]
    assert len(of) >= 9 and max(of) < 150 and sum(size.values()) < 4 * log.count()
    assert form.Pieces(log.limit(0), ["Team"], ["Date", "MatchID"], 30).lent.count() == 0
    with pytest.raises(ValueError):
        form.Pieces(log, ["Team"], ["Date"], 7, days=14)


def test_all_features_in_pieces(spark):
    from tests.test_operators import league

    teams = form.team_log(league(spark, 3, 6))
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("MatchID", "Venue", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in form.feature_names()]).collect())
    assert key(form.form_features(teams, 40)) == key(form.form_features(teams))


@pytest.mark.parametrize("width", [14, 90])
def test_snapshots_in_pieces_equal_whole_ones(spark, log, width):
    rng = random.Random(5)
    marks = [(team, None if rng.random() < 0.05 else date(2000, 1, 1) + timedelta(days=rng.randrange(-50, 10_000)), i) for i, team in enumerate(["busy", "idle", "rare", None, "once", "new"] * 20)]
    up = spark.createDataFrame([*marks, ("busy", date(2000, 3, 1), 900), ("busy", date(2000, 3, 1), 901)], "t string, d date, k long")
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    part = lambda **more: form.snapshot(up, log, "t", "d", "k", ("g",), (3, 10), **more)
    assert part(width=width).dtypes == part().dtypes
    assert key(part(width=width)) == key(part())
