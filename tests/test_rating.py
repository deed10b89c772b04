"""Ratings over groups of teams that meet, against one plain fold over all matches."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitchline.operators import groups, rating

SCHEMA = "MatchID long, Date date, HomeTeam string, AwayTeam string, FTHG int, FTAG int, SeasonStartYear int, id string, _id int"


def plain(rows):
    now, out = {}, {}
    for key, _, h, a, hg, ag, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        eh, ea = now.get(h, 1500.0), now.get(a, 1500.0)
        change = 0.0
        if hg is not None and ag is not None:
            gap = abs(hg - ag)
            won = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
            change = 20 * (1.0 if gap <= 1 else 1.5 if gap == 2 else (11 + gap) / 8) * (won - 1 / (1 + 10 ** (-(eh + 100 - ea) / 400)))
            now[h], now[a] = eh + change, ea - change
        out[key] = tuple(round(x, 6) for x in (eh, ea, eh + change, ea - change))
    return out


@pytest.fixture(scope="module")
def leagues(spark):
    """Ten leagues that never meet within a season; teams change leagues between seasons, and five leagues stay apart for good."""
    rng, rows, key = random.Random(4), [], 0
    places = [f"t{i}" for i in range(30)]
    for season in range(2015, 2019):
        mixed = [*rng.sample(places, 30), *(f"{x}{i}" for x in "abcde" for i in range(6))]
        for of in (mixed[i : i + 6] for i in range(0, 60, 6)):
            for k in range(40):
                h, a = rng.sample(of, 2)
                key += 1
                goals = (None, 1) if rng.random() < 0.05 else (rng.randint(0, 6), rng.randint(0, 4))
                rows.append((key * 7919 % 100_003, date(season, 8, 1) + timedelta(days=k // 2), h, a, *goals, season, "clash", 1))
    rows += [(200_000, date(2015, 8, 2), None, "t1", 1, 0, 2015, "c", 1), (200_001, date(2016, 8, 3), None, "t2", 0, 0, 2016, "c", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def rated(df):
    return {r["id"]: tuple(round(r[c], 6) for c in ("home_pre", "away_pre", "home_post", "away_post")) for r in df.collect()}


@pytest.mark.parametrize("limit", [groups.DRIVER_PAIRS, 3])
def test_groups_and_seasons_rate_like_one_fold(spark, leagues, monkeypatch, limit):
    monkeypatch.setattr(groups, "DRIVER_PAIRS", limit)
    rows, df = leagues
    want = plain(rows)
    assert rated(rating.elo(df)) == want
    assert rated(rating.elo(df, season=F.col("SeasonStartYear"))) == want


def test_matches_are_spread_without_a_league_column(spark, leagues):
    rows, df = leagues
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in rating.elo(df, season=F.col("SeasonStartYear")).withColumn("p", F.spark_partition_id()).groupBy(F.year("day"), "p").count().collect()]
        apart = [r["count"] for r in rating.elo(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(apart) > 1 and max(apart) < len(rows)
    assert len(shares) > 8 and max(shares) < len(rows) / 4


def test_latest_and_joined_ratings(spark, leagues):
    rows, df = leagues
    r = rating.elo(df, season=F.col("SeasonStartYear"))
    last = {x["team"]: round(x["rating"], 6) for x in rating.latest_ratings(r).collect()}
    assert last == {x["team"]: round(x["rating"], 6) for x in rating.latest_ratings(rating.elo(df)).collect()}
    joined = rating.with_ratings(df, r)
    assert joined.columns == [*df.columns, "HomeEloPre", "AwayEloPre", "EloDiffPre"] and joined.count() == len(rows)
    assert rating.elo(df.limit(0)).count() == rating.elo(df.limit(0), season=F.col("SeasonStartYear")).count() == 0


def test_long_chains_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(groups, "DRIVER_PAIRS", 0)
    rng, names = random.Random(2), [f"{i:02d}" for i in range(60)]
    rng.shuffle(names)
    pairs = list(zip(names[:39], names[1:40], strict=False)) + list(zip(names[40:58], names[41:59], strict=False)) + [(names[59], names[59])]
    got = groups.connected(spark.createDataFrame(pairs, "a string, b string")).collect()
    want = {n: min(part) for part in (names[:40], names[40:59], names[59:]) for n in part}
    assert {r["node"]: r["group"] for r in got} == want


def test_a_long_group_is_folded_in_pieces(spark, leagues, monkeypatch):
    rows, df = leagues
    one = df.filter("HomeTeam is not null").withColumns({c: F.concat(F.lit("t"), F.abs(F.hash(c)) % k) for c, k in (("HomeTeam", 7), ("AwayTeam", 5))})
    want = {r[0]: r[1:] for r in ((x["id"], *(x[c] for c in ("home_pre", "away_pre", "home_post", "away_post"))) for x in rating.elo(one).collect())}
    monkeypatch.setattr(rating, "PIECE_ROWS", 150, raising=False)
    for season in (None, F.col("SeasonStartYear")):
        got = rating.elo(one, season=season).withColumn("p", F.spark_partition_id()).collect()
        assert {r["id"]: (r["home_pre"], r["away_pre"], r["home_post"], r["away_post"]) for r in got} == want
        of = [r["p"] for r in got]
        assert max(of.count(p) for p in set(of)) < 400 < len(of) / 3
    assert rated(rating.elo(df)) == plain(rows)


def test_pieces_hand_on_a_row_a_team_and_write_no_matches(spark, leagues, monkeypatch):
    rows, df = leagues
    want = {x["team"]: x["rating"] for x in rating.latest_ratings(rating.elo(df)).collect()}
    monkeypatch.setattr(rating, "PIECE_ROWS", 400)
    tables, handed = [], []
    monkeypatch.setattr(rating, "table", lambda x, *by, write=rating.table: tables.append(1) or write(x, *by))
    monkeypatch.setattr(rating, "cut", lambda x, write=rating.cut: handed.append(write(x)) or handed[-1])
    for season in (None, F.col("SeasonStartYear")):
        tables.clear()
        assert {x["team"]: x["rating"] for x in rating.last_ratings(df, season=season).collect()} == want
        assert len(tables) == 2  # the matches and their pieces, however many pieces there are
    assert len(handed) > 6 and max(k.count() for k in handed) <= len(want)
    tables.clear()
    assert rated(rating.elo(df, season=F.col("SeasonStartYear"))) == plain(rows) and len(tables) == 2
    of = F.substring("HomeTeam", 1, 1)
    one = {(x["league"], x["home"]): x["home_post"] for x in rating.elo(df, league=of).sort("day", "id").collect()}
    two = {(x["league"], x["team"]): x["rating"] for x in rating.last_ratings(df, league=of).collect()}
    assert {k[0] for k in two} == {k[0] for k in one} and set(one) <= set(two)
