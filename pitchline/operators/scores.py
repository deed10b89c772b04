"""Low-score-corrected Poisson scores: rates, correction, marginals, likely scores.

The 11 x 11 grid of a match factors into two vectors but for four cells, so all marginals are
closed sums over 22 columns: no grid rows, no shuffle, whole-stage code.  Only the list of
likely scores needs the cells themselves, as an array over a batch of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import inner
from ..functions.probability import poisson

MAX_GOALS, TOP = 10, 5
TAU_FLOOR = 1e-6
BROADCAST_TEAMS = 100_000


def tau(h: Column, a: Column, rate_h: Column, rate_a: Column, rho: Column) -> Column:
    """Correction of the scores 0-0, 0-1, 1-0 and 1-1; 1 elsewhere."""
    t = F.when((h == 0) & (a == 0), 1 - rate_h * rate_a * rho).when((h == 0) & (a == 1), 1 + rate_h * rho).when((h == 1) & (a == 0), 1 + rate_a * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(1.0)
    return F.greatest(t, F.lit(TAU_FLOOR))


def with_rates(matches: DataFrame, teams: DataFrame, base: float, advantage: float, home: str = "HomeTeam", away: str = "AwayTeam") -> DataFrame:
    """Adds rate_h and rate_a; ``teams`` (team, attack, defence), unknown teams at 0."""
    out, own = matches, inner(matches, "team_h", "attack_h", "defence_h", "team_a", "attack_a", "defence_a")
    small = teams.limit(BROADCAST_TEAMS + 1).count() <= BROADCAST_TEAMS
    for (team, attack, defence), c in ((own[:3], home), (own[3:], away)):
        dim = teams.select(F.col("team").alias(team), F.col("attack").alias(attack), F.col("defence").alias(defence))
        out = out.join(F.broadcast(dim) if small else dim, F.col(c) == F.col(team), "left")
    att_h, def_h, att_a, def_a = (F.coalesce(F.col(own[i]), F.lit(0.0)) for i in (1, 2, 4, 5))
    rate_h, rate_a = F.exp(F.lit(base + advantage) + att_h - def_a), F.exp(F.lit(base) + att_a - def_h)
    return out.select(*[F.col(c) for c in matches.columns], rate_h.alias("rate_h"), rate_a.alias("rate_a"))


def _vectors(df: DataFrame, rho: Column | float, max_goals: int) -> tuple[DataFrame, list[Column], list[Column], dict[tuple[int, int], Column], Column]:
    """``df`` with both sides' goal probabilities and the four corrections as columns, and what the grid sums to."""
    n, (rho_,) = max_goals + 1, inner(df, "rho")
    own = {s: inner(df, *[f"{s}{k}" for k in range(n)]) for s in "ha"}
    cells = dict(zip([(i, j) for i in (0, 1) for j in (0, 1)], inner(df, "x00", "x01", "x10", "x11"), strict=True))
    base = df.withColumn(rho_, rho if isinstance(rho, Column) else F.lit(float(rho)))
    base = base.select("*", *[poisson(F.col(f"rate_{s}"), k).alias(own[s][k]) for s in "ha" for k in range(n)])
    h, a = ([F.col(c) for c in own[s]] for s in "ha")
    lh, la, r = F.col("rate_h"), F.col("rate_a"), F.col(rho_)
    base = base.select("*", *[((tau(F.lit(i), F.lit(j), lh, la, r) - 1) * h[i] * a[j]).alias(c) for (i, j), c in cells.items()])
    x = {at: F.col(c) for at, c in cells.items()}
    return base, h, a, x, _add(h) * _add(a) + _add(list(x.values()))


def _add(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0])


def marginals(df: DataFrame, rho: Column | float, max_goals: int = MAX_GOALS) -> DataFrame:
    """Adds P_HomeWin, P_Draw, P_AwayWin, P_Over25, P_Under25, P_BTTS_Yes, P_BTTS_No to rows with rate_h and rate_a."""
    base, h, a, x, total = _vectors(df, rho, max_goals)
    n = max_goals + 1
    wins = _add([h[k] * _add(a[:k]) for k in range(1, n)]) + x[1, 0]
    loses = _add([a[k] * _add(h[:k]) for k in range(1, n)]) + x[0, 1]
    draws = _add([h[k] * a[k] for k in range(n)]) + x[0, 0] + x[1, 1]
    under = h[0] * (a[0] + a[1] + a[2]) + h[1] * (a[0] + a[1]) + h[2] * a[0] + _add(list(x.values()))
    both = _add(h[1:]) * _add(a[1:]) + x[1, 1]
    own = dict(zip("twldub", inner(df, "total", "wins", "loses", "draws", "under", "both"), strict=True))
    base = base.select(*[F.col(c) for c in df.columns], *[c.alias(own[k]) for k, c in {"t": total, "w": wins, "l": loses, "d": draws, "u": under, "b": both}.items()])
    share = lambda c: F.col(own[c]) / F.col(own["t"])
    return base.select(*[F.col(c) for c in df.columns], share("w").alias("P_HomeWin"), share("d").alias("P_Draw"), share("l").alias("P_AwayWin"), (1 - share("u")).alias("P_Over25"), share("u").alias("P_Under25"), share("b").alias("P_BTTS_Yes"), (1 - share("b")).alias("P_BTTS_No"))


def _likeliest(top: int, max_goals: int):
    """Appends the list of likely scores to batches whose last columns are the two rates and rho."""
    goals = np.arange(max_goals + 1)
    factorial = np.array([math.factorial(k) for k in goals], float)
    labels = pa.array([f"{h}-{a}" for h in goals for a in goals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate_h, rate_a, rho = (batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in range(batch.num_columns - 3, batch.num_columns))
            h, a = (np.exp(-r) * r**goals / factorial for r in (rate_h, rate_a))
            cells = h[:, :, None] * a[:, None, :]
            low = np.concatenate([1 - rate_h * rate_a * rho, 1 + rate_h * rho, 1 + rate_a * rho, 1 - rho], axis=1).reshape(-1, 2, 2)
            cells[:, :2, :2] *= np.maximum(low, TAU_FLOOR)
            cells = cells.reshape(len(cells), -1)
            best = np.argsort(np.rint(-1e12 * cells), axis=1, kind="stable")[:, :top]
            share = np.take_along_axis(cells, best, axis=1) / cells.sum(axis=1, keepdims=True)
            ends = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
            pairs = pa.StructArray.from_arrays([labels.take(pa.array(best.ravel())), pa.array(share.ravel())], names=["score", "probability"])
            known = pa.array(np.isfinite(cells).all(axis=1))
            lists = pc.if_else(known, pa.ListArray.from_arrays(pa.array(ends), pairs), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], lists], names=[*batch.schema.names[:-3], "top_scorelines"])

    return run


def top_scores(df: DataFrame, rho: Column | float, top: int = TOP, max_goals: int = MAX_GOALS) -> DataFrame:
    """Adds top_scorelines: array<struct<score, probability>> of the ``top`` most probable scores; null where a rate is.

    Probabilities that agree to twelve digits count as equal; fewer goals come first then.  The grid of a
    row is only sorted here, a batch of rows at a time; no grid leaves its batch.
    """
    own = inner(df, "rate_h", "rate_a", "rho")
    work = df.select("*", F.col("rate_h").cast("double").alias(own[0]), F.col("rate_a").cast("double").alias(own[1]), (rho if isinstance(rho, Column) else F.lit(float(rho))).alias(own[2]))
    shape = StructType([*df.schema.fields, *StructType.fromDDL("top_scorelines array<struct<score: string, probability: double>>").fields])
    return work.mapInArrow(_likeliest(top, max_goals), shape)


def score_matrix(df: DataFrame, rho: Column | float, key: str, max_goals: int = MAX_GOALS) -> DataFrame:
    """(key, h, a, probability): the grid as a relation; its cells are normalised within their row before they part."""
    base, h, a, x, total = _vectors(df, rho, max_goals)
    n = range(max_goals + 1)
    cells = F.array(*[F.struct(F.lit(i).alias("h"), F.lit(j).alias("a"), (h[i] * a[j] + (x[i, j] if (i, j) in x else F.lit(0.0))).alias("p")) for i in n for j in n])
    return base.select(key, total.alias("_t"), F.explode(cells).alias("c")).select(key, "c.h", "c.a", (F.col("c.p") / F.col("_t")).alias("probability"))


def time_weight(day: Column, as_of: Column, half_life: float = 260.0) -> Column:
    """Halves every ``half_life`` days before ``as_of``; days after it weigh 1."""
    return F.exp(-F.lit(0.6931471805599453 / half_life) * F.greatest(F.datediff(as_of, day), F.lit(0)))


def sufficient_statistics(matches: DataFrame, as_of: Column, half_life: float = 260.0, date: str = "Date", home: str = "HomeTeam", away: str = "AwayTeam", home_goals: str = "FTHG", away_goals: str = "FTAG") -> DataFrame:
    """(home, away, hg, ag, w): time-weighted counts of each score of each pairing, all that the likelihood needs."""
    rows = matches.select(F.col(home).alias("home"), F.col(away).alias("away"), F.col(home_goals).cast("int").alias("hg"), F.col(away_goals).cast("int").alias("ag"), time_weight(F.to_date(date), as_of, half_life).alias("w"))
    return rows.groupBy("home", "away", "hg", "ag").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
