"""Elo ratings: a fold over matches in order of date.

The recurrence crosses teams, so it is no window; but it crosses only teams that meet, directly or through others.
Groups of such teams are dealt to partitions and sorted; each partition streams its rows and keeps one number a team, never a
group's matches.  Groups over the whole history are large where teams change leagues; by season they are
smaller, and seasons follow one another with the ratings handed on.  A group of very many matches is cut by date into
pieces of a bounded number of rows; a piece is a task of its own and hands its ratings on to the next.  Pieces are sorted once, side
by side, and stored as arrays; what follows one another is only the fold over these, which gives a row a team.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inner
from ..plans.lineage import cut, table
from .groups import connected

START, K_FACTOR, HOME_ADVANTAGE = 1500.0, 20.0, 100.0

#: Matches of a group that one task sorts and folds, about.
PIECE_ROWS = 1_000_000

#: Matches that a task turns into Python numbers at a time, about.
SPAN_ROWS = 50_000


def expected(home: Column, away: Column, advantage: float = HOME_ADVANTAGE) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home + advantage - away) / 400))


def margin(gap: Column) -> Column:
    """1, 1.5 or (11 + gap) / 8 for a goal difference of up to 1, of 2, or more."""
    gap = F.abs(gap)
    return F.when(gap <= 1, 1.0).when(gap == 2, 1.5).otherwise((11 + gap) / 8)


_OUT = ("id", "league", "day", "home", "away", "home_pre", "away_pre", "home_post", "away_post")
_LISTS = ("home", "away", "gain", "won", "id", "day")


def _pack(lists: tuple[str, ...]):
    """Matches in order of group, date and key as blocks: a row for a group in a batch, its matches in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in enumerate(batches):
            ends = pc.run_end_encode(batch.column("group")).run_ends.to_pylist()
            offsets = pa.array([0, *ends], pa.int32())
            of = [batch.column(c).take(offsets[:-1]) for c in ("season", "group", "league")]
            arrays = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in lists]
            yield pa.RecordBatch.from_arrays([*of, pa.array([block] * len(ends), pa.int32()), *arrays], names=["season", "group", "league", "block", *lists])

    return run


def _fold(advantage: float, start: float, ratings: bool):
    """Blocks of a group and step in their order, after rows with a rating, which set their team's.

    Gives each match with its ratings; with ``ratings`` a row (league, team, rating) for each team at the end of a group and step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, league, now, team = None, None, {}, None

        def teams(column: pa.Array) -> list:
            coded = column.dictionary_encode("encode")
            names = coded.dictionary.to_pylist()
            return [names[i] for i in coded.indices.to_numpy().tolist()]

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([league] * len(now), pa.string()), pa.array(list(now), team), pa.array(list(now.values()), pa.float64())], names=["league", "team", "rating"])

        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column("home")), 0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SPAN_ROWS)) + 1).tolist(), len(whole)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                batch, lengths = whole.slice(low, high - low), sizes[low:high]
                flat = {c: batch.column(c).flatten() for c in _LISTS if c in batch.schema.names}
                team = flat["home"].type
                matches = zip(teams(flat["home"]), teams(flat["away"]), flat["gain"].to_numpy().tolist(), flat["won"].to_numpy().tolist(), strict=True)
                pre_h, pre_a, changes = [], [], []
                for group, step, of, given, rating, n in zip(*(batch.column(c).to_pylist() for c in ("group", "step", "league", "team", "rating")), lengths.tolist(), strict=True):
                    if (group, step) != unit:
                        if ratings and now:
                            yield ended()
                        unit, league, now = (group, step), of, defaultdict(lambda: start)
                    if rating is not None:
                        now[given] = rating
                    for h, a, gain, won in islice(matches, n):
                        x, y = now[h], now[a]
                        change = gain * (won - 1 / (1 + 10.0 ** (-(x + advantage - y) / 400)))
                        now[h] = x + change
                        now[a] = y - change
                        pre_h.append(x)
                        pre_a.append(y)
                        changes.append(change)
                if not ratings:
                    h, a, c = np.array(pre_h, float), np.array(pre_a, float), np.array(changes, float)
                    leagues = batch.column("league").take(pa.array(np.repeat(np.arange(len(batch)), lengths)))
                    yield pa.RecordBatch.from_arrays([flat["id"], leagues, flat["day"], flat["home"], flat["away"], *map(pa.array, (h, a, h + c, a - c))], names=list(_OUT))
        if ratings and now:
            yield ended()

    return run


def _node(team: str) -> Column:
    """A team of a league and season as text, nulls included."""
    return F.to_json(F.struct("league", "season", F.col(team).alias("team")))


def elo(matches: DataFrame, key: str = "MatchID", date: str = "Date", home: str = "HomeTeam", away: str = "AwayTeam", home_goals: str = "FTHG", away_goals: str = "FTAG", league: Column | None = None, k: float = K_FACTOR, advantage: float = HOME_ADVANTAGE, start: float = START, season: Column | None = None) -> DataFrame:
    """(id, league, day, home, away, home_pre, away_pre, home_post, away_post) of each match.

    Rows of one day are folded in the order of their key.  A match without goals changes nothing.  A null team is a team.
    Without ``league`` teams that never meet, even through others, are still rated apart, in tasks of their own.  With
    ``season`` (a number that doesn't fall with the date; null comes first) groups are those of a season, one job or more a
    season.  Groups of more than about PIECE_ROWS matches take a job a piece, for the ratings it hands on; then all pieces
    are rated side by side.
    """
    return _rated(_rows(matches, key, date, home, away, home_goals, away_goals, league, k, season), advantage, start, season is not None, False)


def last_ratings(matches: DataFrame, key: str = "MatchID", date: str = "Date", home: str = "HomeTeam", away: str = "AwayTeam", home_goals: str = "FTHG", away_goals: str = "FTAG", league: Column | None = None, k: float = K_FACTOR, advantage: float = HOME_ADVANTAGE, start: float = START, season: Column | None = None, digits: int | None = None) -> DataFrame:
    """(league, team, rating) after a team's last match in its league: ``latest_ratings`` of ``elo`` without the matches' rows."""
    last = _rated(_rows(matches, key, date, home, away, home_goals, away_goals, league, k, season), advantage, start, season is not None, True)
    return last if digits is None else last.withColumn("rating", F.round("rating", digits))


def _rows(matches: DataFrame, key: str, date: str, home: str, away: str, home_goals: str, away_goals: str, league: Column | None, k: float, season: Column | None) -> DataFrame:
    of = (league if league is not None else F.lit("all")).cast("string")
    rows = matches.select(F.col(key).alias("id"), of.alias("league"), F.to_date(date).alias("day"), F.col(home).alias("home"), F.col(away).alias("away"), F.col(home_goals).cast("int").alias("hg"), F.col(away_goals).cast("int").alias("ag"), (season if season is not None else F.lit(0)).cast("int").alias("season"))
    # A match without goals gains nothing, whatever is expected of it.
    gap, won = F.col("hg") - F.col("ag"), F.when(F.col("hg") > F.col("ag"), 1.0).when(F.col("hg") == F.col("ag"), 0.5).otherwise(0.0)
    return rows.withColumns({"gain": F.when(gap.isNotNull(), F.lit(float(k)) * margin(gap)).otherwise(0.0), "won": won}).drop("hg", "ag")


def _rated(rows: DataFrame, advantage: float, start: float, seasonal: bool, ratings: bool) -> DataFrame:
    t = dict(rows.dtypes)
    rows = table(rows) if seasonal else rows
    count = rows.count()
    whole = not count or (not seasonal and count <= PIECE_ROWS)
    rows = rows if whole or seasonal else table(rows)
    sides = rows.select("league", "season", "home", "away").distinct()
    groups = connected(sides.select(_node("home").alias("a"), _node("away").alias("b")))
    grouped = rows.withColumn("node", _node("home")).join(groups, "node").select("season", "group", "league", *_LISTS)
    lists = _LISTS[:4] if ratings else _LISTS
    packed = f"season int, group string, league string, block int, {', '.join(f'{c} array<{t[c]}>' for c in lists)}"
    none = {"step": F.lit(0), "team": F.lit(None).cast(t["home"]), "rating": F.lit(None).cast("double")}
    last = f"league string, team {t['home']}, rating double"
    result = last if ratings else f"id {t['id']}, league string, day date, home {t['home']}, away {t['away']}, " + ", ".join(f"{c} double" for c in _OUT[5:])
    if whole:
        blocks = grouped.repartition("group").sortWithinPartitions("group", "day", "id").mapInArrow(_pack(lists), packed)
        return blocks.withColumns(none).mapInArrow(_fold(advantage, start, ratings), result)

    order = ["season", "group", "day", "id"]
    parts = math.ceil(count / PIECE_ROWS)
    dealt = grouped.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(lists), packed).withColumn("part", F.spark_partition_id())
    stored = table(dealt, "part").withColumns(none)
    turns, later = _turns(stored)

    def handed(known: DataFrame) -> DataFrame:
        return known.withColumn("node", _node("team")).join(groups, "node").select("group", "step", "league", "team", "rating")

    def fold(part: DataFrame, starts: DataFrame | None, only: bool, kind: str, *spread: int) -> DataFrame:
        part = part.select("group", "step", "league", "block", "team", "rating", *(_LISTS[:4] if only else _LISTS))
        if starts is not None:
            part = part.unionByName(starts, allowMissingColumns=True)
        return part.repartition(*spread, "group", "step").sortWithinPartitions("group", "step", F.col("rating").isNull(), "block").mapInArrow(_fold(advantage, start, only), kind)

    known, starts = None, []
    for i, (season, step, within, own) in enumerate(turns):
        mine = stored.filter(F.col("part").isin(within) & F.col("season").eqNullSafe(F.lit(season))).withColumn("step", F.lit(step))
        if own:
            among = _among("part", "group", own)
            mine = mine.filter(among if step else ~among)
        begins = None
        if known is not None:
            begins = handed(known.withColumns({"season": F.lit(season).cast("int"), "step": F.lit(step)}))
            begins = begins.filter(F.col("group").isin([g for _, g in own])) if step else begins
            starts.append(begins)
        if i + 1 == len(turns) and not ratings:
            break
        new = fold(mine, begins, True, last)
        if known is not None:  # teams that don't play keep theirs
            both = new.withColumn("at", F.lit(1)).unionAll(known.withColumn("at", F.lit(0)))
            new = both.groupBy("league", "team").agg(F.max_by("rating", "at").alias("rating"))
        known = cut(new)
    if ratings:
        return known
    begun = rows.sparkSession.createDataFrame(later, "part int, group string, later int")
    blocks = stored.join(F.broadcast(begun), ["part", "group"], "left").withColumn("step", F.coalesce("later", "step"))
    spread = () if parts == 1 else (4 * parts,)  # a part's pieces mustn't be put together again
    return fold(blocks, reduce(DataFrame.unionAll, starts) if starts else None, False, result, *spread)


def _among(a: str, b: str, pairs: list[tuple]) -> Column:
    return F.array_contains(F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in pairs]), F.struct(a, b))


def _turns(stored: DataFrame) -> tuple[list[tuple[int | None, int, list[int], list[tuple[int, str]]]], list[tuple[int, str, int]]]:
    """(season, step, parts it reads, what of them) of each turn of a fold, in order, and (part, group, step) of all that isn't a season's first step.

    What a turn reads of its parts are the (part, group) that it takes or, at a season's first step, those that it leaves out.
    Parts hold about PIECE_ROWS matches in the order of season, group, date and key.  Where a part begins within a group, the group
    goes on one step later than in the part before; all else is a season's first step.
    """
    ends = F.struct("season", "group")
    bounds = stored.groupBy("part").agg(F.min(ends).alias("low"), F.max(ends).alias("high")).sort("part").collect()  # a row a piece
    seasons = [r[0] for r in stored.select("season").distinct().sort("season").collect()]  # a row a season
    later: dict[int, int] = {}  # a part's first group: how many steps after the season's first
    for before, now in zip(bounds, bounds[1:], strict=False):
        if now["low"] == before["high"]:
            later[now["part"]] = 1 + (later.get(before["part"], 0) if before["low"] == before["high"] else 0)
    turns = []
    for place, at in enumerate(seasons):
        within = [r for r in bounds if seasons.index(r["low"]["season"]) <= place <= seasons.index(r["high"]["season"])]
        begun = [r for r in within if r["part"] in later and r["low"]["season"] == at]
        turns.append((at, 0, [r["part"] for r in within if r not in begun or r["low"] != r["high"]], [(r["part"], r["low"]["group"]) for r in begun]))
        for step in range(1, 1 + max((later[r["part"]] for r in begun), default=0)):
            own = [(r["part"], r["low"]["group"]) for r in begun if later[r["part"]] == step]
            turns.append((at, step, [p for p, _ in own], own))
    return turns, [(r["part"], r["low"]["group"], later[r["part"]]) for r in bounds if r["part"] in later]


def with_ratings(matches: DataFrame, rated: DataFrame, key: str = "MatchID") -> DataFrame:
    (own,) = inner(matches, "id")
    pre = rated.select(F.col("id").alias(own), F.col("home_pre").alias("HomeEloPre"), F.col("away_pre").alias("AwayEloPre"), (F.col("home_pre") - F.col("away_pre")).alias("EloDiffPre"))
    return matches.join(pre, matches[key] == F.col(own), "left").drop(own)


def latest_ratings(rated: DataFrame, digits: int | None = None) -> DataFrame:
    """(team, rating): each team's rating after its last match; ``digits`` rounds as the snapshot file does."""
    sides = F.array(F.struct(F.col("home").alias("team"), F.col("home_post").alias("r")), F.struct(F.col("away").alias("team"), F.col("away_post").alias("r")))
    last = rated.select("day", "id", F.explode(sides).alias("s")).groupBy("s.team").agg(F.max_by("s.r", F.struct("day", "id")).alias("rating"))
    return last if digits is None else last.withColumn("rating", F.round("rating", digits))
