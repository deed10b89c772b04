"""Callers' columns may bear any name."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline.functions import names
from pitchline.operators import scores, splits

ODD = ("_th", "_att_h", "_rho", "_h0", "_x00", "_t", "_rate_h", "_alias", "_canonical", "_known", "_s", "__season", "__alias", "__rho", "__team_h", "__h0")


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("A ", "B", 1.2, 0.8, y) for y in (2019, 2020, 2021, 2022)], "HomeTeam string, AwayTeam string, rate_h double, rate_a double, season int").withColumns({c: F.lit("kept") for c in ODD})
    plain = df.drop(*ODD)
    teams = spark.createDataFrame([("B", 0.1, 0.2)], "team string, attack double, defence double")
    alias = spark.createDataFrame([("A", "Alba", 1)], "alias string, canonical string, priority int")
    for f in (lambda d: scores.with_rates(d.drop("rate_h", "rate_a"), teams, 0.1, 0.2), lambda d: scores.marginals(d, -0.1), lambda d: scores.top_scores(d, -0.1), lambda d: names.canonical_names(d, "HomeTeam", alias), lambda d: splits.chronological_split(d, "season"), lambda d: splits.pooled_last(d, "season")):
        got, want = f(df), f(plain)
        assert set(got.columns) == {*want.columns, *ODD}
        rows = got.collect()
        assert all(r[c] == "kept" for r in rows for c in ODD)
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in rows))) == sorted(map(str, map(tuple, want.collect())))
