"""Leakage-safe team form.  A row's features use only rows strictly before it.

All windows of one partitioning share one Exchange and one Sort: lags of every metric are taken in
one select, the weighted means are arithmetic over them.

A team's log may be cut in pieces by time, each lent the rows before it that its windows reach, so that a team with
very many rows is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inner

DECAY, WINDOWS, CONGESTION_DAYS = 0.85, (3, 5, 10), 14
METRICS = ("Result", "GF", "GA", "ShotsF", "SOTF", "xGF", "xGA")
VENUE_METRICS = ("GF", "GA", "Result")


def team_log(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for each side, without a shuffle; absent statistics are null."""
    num = lambda c: F.col(c).cast("double") if c in matches.columns else F.lit(None).cast("double")
    side = lambda v, t, o, p, q: F.struct(
        F.lit(v).alias("Venue"), F.col(t).alias("Team"), F.col(o).alias("Opponent"), num(f"FT{p}G").alias("GF"), num(f"FT{q}G").alias("GA"),
        F.when(num(f"FT{p}G") > num(f"FT{q}G"), 1.0).when(num(f"FT{p}G") < num(f"FT{q}G"), 0.0).when(num(f"FT{p}G").isNotNull() & num(f"FT{q}G").isNotNull(), 0.5).alias("Result"),
        num(f"{p}S").alias("ShotsF"), num(f"{q}S").alias("ShotsA"), num(f"{p}ST").alias("SOTF"), num(f"{q}ST").alias("SOTA"), num(f"{p}C").alias("CornersF"), num(f"{q}C").alias("CornersA"), num(f"{p}xG").alias("xGF"), num(f"{q}xG").alias("xGA"))
    keys = [c for c in ("MatchID", "Date", "Season", "SeasonStartYear") if c in matches.columns]
    sides = F.array(side("H", "HomeTeam", "AwayTeam", "H", "A"), side("A", "AwayTeam", "HomeTeam", "A", "H"))
    return matches.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")


def weighted_form(df: DataFrame, keys: list[str], order: list[str], metrics: tuple[str, ...], windows: tuple[int, ...] = WINDOWS, decay: float = DECAY, prefix: str = "") -> DataFrame:
    """Adds ``<prefix><metric>_L<w>``: the mean of the previous up to w values, the newest weighing most.

    A missing value leaves its weight unused; without values the mean is null.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    deepest = max(windows)
    lags = {f"_{m}_{k}": F.lag(m, k).over(w) for m in metrics for k in range(1, deepest + 1)}
    out = df.select("*", *[c.alias(n) for n, c in lags.items()])
    means = []
    for m in metrics:
        for n in windows:
            top = sum((F.coalesce(F.col(f"_{m}_{k}"), F.lit(0.0)) * decay ** (k - 1) for k in range(1, n + 1)), F.lit(0.0))
            low = sum((F.when(F.col(f"_{m}_{k}").isNotNull(), decay ** (k - 1)).otherwise(0.0) for k in range(1, n + 1)), F.lit(0.0))
            means.append(F.when(low > 0, top / low).alias(f"{prefix}{m}_L{n}"))
    return out.select(*[F.col(c) for c in df.columns], *means)


def schedule_load(df: DataFrame, keys: list[str], date: str, order: list[str], days: int = CONGESTION_DAYS) -> DataFrame:
    """Adds MatchesPlayedPrior, RestDays (null first) and MatchesLast14Days (prior rows within ``days``).

    The count subtracts older rows from prior ones, so rows of one day count right in their order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    older = Window.partitionBy(*keys).orderBy(F.unix_date(F.to_date(date))).rangeBetween(Window.unboundedPreceding, -days)
    prior = F.row_number().over(w) - 1
    return df.select("*", prior.alias("MatchesPlayedPrior"), F.datediff(F.to_date(date), F.lag(F.to_date(date)).over(w)).alias("RestDays"), (prior - F.count("*").over(older)).cast("int").alias("MatchesLast14Days"))


class Pieces:
    """A log cut by time: pieces of ``width`` days a key, each with the last ``rows`` rows and ``days`` days before it on loan.

    ``lent`` is the log with loans, ``keys`` the columns by which its windows are partitioned; ``settle`` drops the
    loans again.  The first column of ``order`` is the date or time; rows without one stand before all others.  Rows that
    ``marks`` tells are borrowers only: they are lent to no piece and not counted.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], width: int, rows: int = max(WINDOWS), days: int = 0, marks: Column | None = None) -> None:
        if width < max(1, days):
            raise ValueError("a piece is at least as long as its loan in days")
        piece, lent, self._before, place, n, targets, t = inner(df, "piece", "lent", "before", "place", "n", "targets", "t")
        self._columns, self._lent, self.keys = df.columns, lent, [*keys, piece]
        day = F.unix_date(F.to_date(order[0]))
        own = df.withColumn(piece, F.coalesce(F.floor(day / width), F.lit(-(2**40))))
        backwards = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in order])
        # What a piece lends: to the next pieces, until those between have rows enough.  A key has a row a piece here.
        lenders = own if marks is None else own.filter(~marks)
        sizes = own.groupBy(*self.keys).agg((F.count("*") if marks is None else F.count_if(~marks)).alias(n))
        by_time = Window.partitionBy(*keys).orderBy(piece)
        # Pieces of marks alone fill no loan, so with marks any later piece may borrow.
        after = F.collect_list(F.struct(F.col(piece).alias("p"), F.col(n).alias("n"))).over(by_time.rowsBetween(1, rows if marks is None else Window.unboundedFollowing))
        before = F.sum(n).over(by_time)
        gap = lambda i: F.aggregate(F.slice(targets, F.lit(1), i), F.lit(0).cast("long"), lambda x, y: x + y["n"])
        lending = sizes.select(*self.keys, before.alias(self._before), after.alias(targets))
        lending = lending.withColumn(targets, F.transform(targets, lambda x, i: F.struct(x["p"].alias("p"), gap(i).alias("gap"))))
        lending = lending.select(*[F.col(k).alias(f"{t}{i}") for i, k in enumerate(self.keys)], self._before, F.explode(targets).alias(t))
        same = [F.col(k).eqNullSafe(F.col(f"{t}{i}")) for i, k in enumerate(self.keys)]
        last = lenders.withColumn(place, F.row_number().over(backwards)).filter(F.col(place) <= rows)
        loans = [last.join(lending, same).filter(F.col(place) + F.col(f"{t}.gap") <= rows).withColumn(piece, F.col(f"{t}.p")).withColumn(self._before, F.col(self._before) + F.col(f"{t}.gap"))]
        if days:  # the end of a piece is its last rows, so their places count from its end too
            end = lenders.filter(day > (F.col(piece) + 1) * width - days).withColumn(place, F.row_number().over(backwards)).filter(F.col(place) > rows)
            loans.append(end.withColumns({piece: F.col(piece) + 1, self._before: F.lit(None).cast("long")}))
        out = own.withColumns({lent: F.lit(False), self._before: F.lit(None).cast("long")})
        for loan in loans:
            out = out.unionByName(loan.withColumn(lent, F.lit(True)).select(*out.columns))
        self.lent = out

    def more(self) -> Column:
        """How many rows before a piece it wasn't lent."""
        w = Window.partitionBy(*self.keys)
        return F.coalesce(F.max(self._before).over(w), F.lit(0)) - F.count_if(F.col(self._lent)).over(w)

    def settle(self, df: DataFrame, prior: str | None = None) -> DataFrame:
        """``df`` without loans and working columns; ``prior``, a count of earlier rows, gets those of earlier pieces added."""
        if prior:
            df = df.withColumn(prior, (F.col(prior) + self.more()).cast("int"))
        return df.filter(~F.col(self._lent)).drop(self.keys[-1], self._lent, self._before)


def form_features(log: DataFrame, width: int | None = None) -> DataFrame:
    """The log with rolling form, load and venue-split form; with ``width`` in pieces of so many days a team."""
    order = ["Date", "MatchID"]
    if width is None:
        out = schedule_load(weighted_form(log, ["Team"], order, METRICS), ["Team"], "Date", order)
        return weighted_form(out, ["Team", "Venue"], order, VENUE_METRICS, (5,), prefix="Venue")
    p = Pieces(log, ["Team"], order, width, days=CONGESTION_DAYS)
    out = p.settle(schedule_load(weighted_form(p.lent, p.keys, order, METRICS), p.keys, "Date", order), "MatchesPlayedPrior")
    p = Pieces(out, ["Team", "Venue"], order, width, rows=5)
    return p.settle(weighted_form(p.lent, p.keys, order, VENUE_METRICS, (5,), prefix="Venue"))


def feature_names() -> list[str]:
    return [f"{m}_L{w}" for m in METRICS for w in WINDOWS] + ["MatchesPlayedPrior", "RestDays", "MatchesLast14Days"] + [f"Venue{m}_L5" for m in VENUE_METRICS]


def merge_sides(matches: DataFrame, featured: DataFrame) -> DataFrame:
    """Matches with Home_ and Away_ features; one aggregation by match turns both sides into one row.

    The match's own statistics don't come along: only features of earlier rows do.
    """
    at = lambda v, c: F.max(F.when(F.col("Venue") == v, F.col(c)))
    wide = featured.groupBy("MatchID").agg(*[at(v, c).alias(f"{n}_{c}") for v, n in (("H", "Home"), ("A", "Away")) for c in feature_names()])
    return matches.join(wide, "MatchID", "left")


def snapshot(upcoming: DataFrame, log: DataFrame, team: str, as_of: str, key: str, metrics: tuple[str, ...] = METRICS, windows: tuple[int, ...] = WINDOWS, venue: Column | None = None, order: tuple[str, ...] = ("Date", "MatchID"), decay: float = DECAY, date: str = "Date", log_team: str = "Team", width: int | None = None) -> DataFrame:
    """As-of features: per row of ``upcoming`` the weighted means over its team's last rows with a date before ``as_of``.

    ``venue`` restricts the log rows.  A team may have any number of upcoming rows.  Upcoming rows stand in the
    log as markers before the rows of their day; one window by team looks back over rows that aren't markers,
    so there is one shuffle and no join.  Rows without a team or date have no history and are none.  With ``width`` the log
    is cut in pieces of so many days a team.
    """
    rows = log if venue is None else log.filter(venue)
    past = rows.filter(F.col(log_team).isNotNull() & F.to_date(date).isNotNull())
    past = past.select(F.col(log_team).alias("_team"), F.to_date(date).alias("_day"), F.lit(0).alias("_mark"), F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("_s"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    marks = upcoming.select(F.col(team).alias("_team"), F.to_date(as_of).alias("_day"), F.lit(1).alias("_mark"), F.struct(*[F.col(c) for c in upcoming.columns]).alias("_up"))
    both = past.unionByName(marks, allowMissingColumns=True)
    keys, more = ["_team"], F.lit(0)
    if width is not None:
        p = Pieces(both, keys, ["_day", *[f"_o{i}" for i in range(len(order))]], width, max(windows), CONGESTION_DAYS, F.col("_mark") == 1)
        both, keys, more = p.lent, p.keys, p.more()
    by = ", ".join(["_day", "_mark DESC", *[f"_o{i}" for i in range(len(order))]])
    lags = [F.expr(f"lag(_s, {k}) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {by})").alias(f"_{k}") for k in range(1, max(windows) + 1)]
    w = Window.partitionBy(*keys).orderBy("_day", F.col("_mark").desc(), *[f"_o{i}" for i in range(len(order))])
    recent = Window.partitionBy(*keys).orderBy(F.unix_date("_day")).rangeBetween(1 - CONGESTION_DAYS, -1)
    seen = F.when(F.col("_mark") == 0, F.col("_day"))
    loads = [(F.count(seen).over(w) + more).alias("MatchesPlayedPrior"), F.datediff("_day", F.last(seen, ignorenulls=True).over(w)).alias("RestDays"), F.count(seen).over(recent).alias("MatchesLast14Days")]
    got = both.select("_up", "_mark", *lags, *loads).filter("_mark = 1")
    means = []
    for m in metrics:
        for n in windows:
            top = sum((F.coalesce(F.col(f"_{k}.{m}"), F.lit(0.0)) * decay ** (k - 1) for k in range(1, n + 1)), F.lit(0.0))
            low = sum((F.when(F.col(f"_{k}.{m}").isNotNull(), decay ** (k - 1)).otherwise(0.0) for k in range(1, n + 1)), F.lit(0.0))
            means.append(F.when(low > 0, top / low).alias(f"{m}_L{n}"))
    return got.select("_up.*", "MatchesPlayedPrior", "RestDays", "MatchesLast14Days", *means)


def features_for_upcoming(upcoming: DataFrame, log: DataFrame, ratings: DataFrame, default_rating: float = 1500.0, width: int | None = None) -> DataFrame:
    """Serving features: ``upcoming`` (MatchID, Date, HomeTeam, AwayTeam) with both sides' snapshots and ratings.

    Played rows of the log on the day itself or later never count.  Venue features are those of the side's own venue.
    ``width``: days of a piece of a team's log.
    """
    sides = F.array(F.struct(F.lit("H").alias("Venue"), F.col("HomeTeam").alias("Team")), F.struct(F.lit("A").alias("Venue"), F.col("AwayTeam").alias("Team")))
    two = upcoming.select("MatchID", "Date", F.explode(sides).alias("s")).select("MatchID", "Date", "s.*").withColumn("_side", F.concat("Venue", F.lit("|"), "MatchID"))
    every = snapshot(two, log, "Team", "Date", "_side", width=width)
    parts = []
    for v in ("H", "A"):
        one = snapshot(two.filter(F.col("Venue") == v), log, "Team", "Date", "_side", VENUE_METRICS, (5,), venue=F.col("Venue") == v, width=width)
        parts.append(one.select("_side", *[F.col(f"{m}_L5").alias(f"Venue{m}_L5") for m in VENUE_METRICS]))
    featured = every.join(parts[0].unionByName(parts[1]), "_side")
    out = merge_sides(upcoming, featured)
    for side in ("Home", "Away"):
        out = out.join(ratings.select(F.col("team").alias(f"_{side}"), F.col("rating").alias(f"_r{side}")), F.col(f"{side}Team") == F.col(f"_{side}"), "left")
        out = out.withColumn(f"{side}EloPre", F.coalesce(F.col(f"_r{side}"), F.lit(default_rating))).drop(f"_{side}", f"_r{side}")
    return out.withColumn("EloDiffPre", F.col("HomeEloPre") - F.col("AwayEloPre"))
