"""Penalised, time-weighted fit of the low-score-corrected Poisson model.

Spark sums the likelihood's sufficient statistics by pairing and score.  A projected quasi-Newton method with the
analytic gradient fits attack and defence of each team, home advantage, base rate and rho.  Up to a number of
statistics the likelihood is summed on the driver; beyond it each value and gradient is a Spark job that joins the statistics with
their teams' parameters and sums by team, so that what reaches the driver is a row a team.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scores import TAU_FLOOR, sufficient_statistics
from .lineage import cut

#: Penalty, bounds (attack and defence, advantage, base, rho), shrinkage in matches.
RIDGE, SHRINK = 0.01, 3.0
BOUNDS = {"team": (-3.0, 3.0), "advantage": (-0.2, 1.0), "base": (-1.0, 2.0), "rho": (-0.3, 0.3)}
ROUNDS, MEMORY = 500, 12


@dataclass
class ScoreModel:
    attack: dict
    defence: dict
    advantage: float
    base: float
    rho: float

    def teams(self, spark: SparkSession) -> DataFrame:
        """The parameters as a table (team, attack, defence)."""
        rows = [(t, float(self.attack[t]), float(self.defence[t])) for t in self.attack]
        kind = "long" if rows and isinstance(rows[0][0], int) else "string"
        return spark.createDataFrame(rows, f"team {kind}, attack double, defence double")


def objective(x: np.ndarray, h: np.ndarray, a: np.ndarray, hg: np.ndarray, ag: np.ndarray, w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood (constants aside) and its gradient; x: attacks, defences, advantage, base, rho."""
    att, dfc, adv, base, rho = x[:n], x[n : 2 * n], x[2 * n], x[2 * n + 1], x[2 * n + 2]
    log_h, log_a = base + adv + att[h] - dfc[a], base + att[a] - dfc[h]
    lh, la = np.exp(log_h), np.exp(log_a)
    cells = [(hg == 0) & (ag == 0), (hg == 0) & (ag == 1), (hg == 1) & (ag == 0), (hg == 1) & (ag == 1)]
    tau = np.select(cells, [1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, np.full(len(lh), 1 - rho)], 1.0)
    free = (tau > TAU_FLOOR) / np.maximum(tau, TAU_FLOOR)
    dh = np.select(cells, [-lh * la * rho, lh * rho, 0 * lh, 0 * lh], 0.0) * free
    da = np.select(cells, [-lh * la * rho, 0 * lh, la * rho, 0 * lh], 0.0) * free
    dr = np.select(cells, [-lh * la, lh, la, -np.ones(len(lh))], 0.0) * free
    value = -(w * (np.log(np.maximum(tau, TAU_FLOOR)) + hg * log_h - lh + ag * log_a - la)).sum() + RIDGE * ((att**2).sum() + (dfc**2).sum())
    gh, ga = w * (hg - lh + dh), w * (ag - la + da)
    g_att = np.bincount(h, gh, n) + np.bincount(a, ga, n)
    g_def = -np.bincount(a, gh, n) - np.bincount(h, ga, n)
    return value, -np.concatenate([g_att - 2 * RIDGE * att, g_def - 2 * RIDGE * dfc, [gh.sum(), (gh + ga).sum(), (w * dr).sum()]])


def minimise(f, x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Limited-memory quasi-Newton steps, projected onto the box; coordinates held at a bound don't move."""
    value, grad = f(x)
    s_list, y_list = [], []
    for _ in range(rounds):
        held = ((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0))
        free = np.where(held, 0.0, grad)
        if np.abs(free).max() < 1e-7 * max(1.0, abs(value)):
            break
        q, alphas = free.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for s, y, al in zip(s_list, y_list, reversed(alphas), strict=True):
            q += s * (al - (y @ q) / (y @ s))
        q = np.where(held, 0.0, q)
        if q @ free <= 0:
            q, s_list, y_list = free, [], []
        step = 1.0 if s_list else min(1.0, 1.0 / np.abs(q).max())
        for _ in range(40):
            new = np.clip(x - step * q, low, high)
            v, g = f(new)
            if v <= value - 1e-4 * (grad @ (x - new)):
                break
            step /= 2
        else:
            break
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-MEMORY:], [*y_list, y][-MEMORY:]
        done = value - v <= 1e-12 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


#: Rows of statistics that the driver sums: 40 bytes each, some 1,000 teams that all play one another.
MOST_ROWS = 10_000_000
#: Teams whose parameters go to every task; more are joined.
BROADCAST_TEAMS = 200_000


class Statistics:
    """Sufficient statistics with teams as numbers, and the objective over them, on the driver or in Spark."""

    def __init__(self, rows: DataFrame) -> None:
        known = rows.filter("home is not null and away is not null and hg is not null and ag is not null")
        self.spark, stats = rows.sparkSession, cut(known)
        sides = stats.select(F.explode(F.array("home", "away")).alias("team")).distinct()
        self.teams = sorted(r["team"] for r in sides.collect())  # parameters are a row a team, too
        self.n, self.here = len(self.teams), stats.count() <= MOST_ROWS
        if self.here:
            at = {t: i for i, t in enumerate(self.teams)}
            got = stats.toPandas().sort_values(["home", "away", "hg", "ag"])
            self.h, self.a = (got[c].map(at).to_numpy(int) for c in ("home", "away"))
            self.hg, self.ag, self.w, self.played = (got[c].to_numpy(float) for c in ("hg", "ag", "w", "n"))
            return
        kind = dict(stats.dtypes)["home"]
        numbers = self._small(self.spark.createDataFrame(list(enumerate(self.teams)), f"i int, team {kind}"))
        both = stats.join(numbers.withColumnsRenamed({"i": "h", "team": "home"}), "home").join(numbers.withColumnsRenamed({"i": "a", "team": "away"}), "away")
        self.stats = cut(both.select("h", "a", F.col("hg").cast("double").alias("hg"), F.col("ag").cast("double").alias("ag"), "w", F.col("n").cast("double").alias("n")))

    def _small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.n <= BROADCAST_TEAMS else table

    def goals_and_games(self) -> tuple[float, np.ndarray]:
        """(home goals a match, matches of each team)."""
        if self.here:
            return (self.hg * self.played).sum() / self.played.sum(), np.bincount(self.h, self.played, self.n) + np.bincount(self.a, self.played, self.n)
        mean = self.stats.agg(F.sum(F.col("hg") * F.col("n")) / F.sum("n")).first()[0]
        games = np.zeros(self.n)
        for i, n in self.stats.select(F.explode(F.array("h", "a")).alias("i"), "n").groupBy("i").agg(F.sum("n")).collect():
            games[i] = n
        return mean, games

    def objective(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised negative log-likelihood (constants aside) and its gradient; x: attacks, defences, advantage, base, rho."""
        if self.here:
            return objective(x, self.h, self.a, self.hg, self.ag, self.w, self.n)
        n = self.n
        att, dfc, (adv, base, rho) = x[:n], x[n : 2 * n], (float(v) for v in x[2 * n :])
        table = self._small(self.spark.createDataFrame(list(zip(range(n), att.tolist(), dfc.tolist(), strict=True)), "i int, att double, def double"))
        side = lambda s: table.select(F.col("i").alias(s), F.col("att").alias(f"att_{s}"), F.col("def").alias(f"def_{s}"))
        j = self.stats.join(side("h"), "h").join(side("a"), "a")
        log_h, log_a = F.lit(base + adv) + F.col("att_h") - F.col("def_a"), F.lit(base) + F.col("att_a") - F.col("def_h")
        j = j.select("h", "a", "hg", "ag", "w", log_h.alias("log_h"), log_a.alias("log_a"), F.exp(log_h).alias("lh"), F.exp(log_a).alias("la"))
        lh, la, hg, ag, w = (F.col(c) for c in ("lh", "la", "hg", "ag", "w"))
        low = lambda a, b, c, d, other: F.when((hg == 0) & (ag == 0), a).when((hg == 0) & (ag == 1), b).when((hg == 1) & (ag == 0), c).when((hg == 1) & (ag == 1), d).otherwise(F.lit(other))
        j = j.withColumns({"tau": low(1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, F.lit(1 - rho), 1.0), "dh": low(-lh * la * rho, lh * rho, F.lit(0.0), F.lit(0.0), 0.0), "da": low(-lh * la * rho, F.lit(0.0), la * rho, F.lit(0.0), 0.0), "dr": low(-lh * la, lh, la, F.lit(-1.0), 0.0)})
        tau = F.greatest("tau", F.lit(TAU_FLOOR))
        free = F.when(F.col("tau") > TAU_FLOOR, 1 / tau).otherwise(0.0)
        value = w * (F.log(tau) + hg * F.col("log_h") - lh + ag * F.col("log_a") - la)
        j = j.select("h", "a", (w * (hg - lh + F.col("dh") * free)).alias("gh"), (w * (ag - la + F.col("da") * free)).alias("ga"), (w * F.col("dr") * free).alias("gr"), value.alias("v"))
        none = F.lit(0.0)
        of = lambda i, att, dfc, adv, rho, v: F.struct(i.alias("i"), att.alias("att"), dfc.alias("def"), adv.alias("adv"), rho.alias("rho"), v.alias("v"))
        gh, ga = F.col("gh"), F.col("ga")
        sides = F.array(of(F.col("h"), gh, -ga, gh, F.col("gr"), F.col("v")), of(F.col("a"), ga, -gh, none, none, none))
        sums = j.select(F.explode(sides).alias("s")).groupBy("s.i").agg(*[F.sum(f"s.{c}").alias(c) for c in ("att", "def", "adv", "rho", "v")])
        got = np.zeros((n, 5))
        for i, *row in sums.collect():
            got[i] = row
        g_adv, g_rho, total = got[:, 2].sum(), got[:, 3].sum(), got[:, 4].sum()
        gradient = np.concatenate([got[:, 0] - 2 * RIDGE * att, got[:, 1] - 2 * RIDGE * dfc, [g_adv, got[:, 0].sum(), g_rho]])
        return -total + RIDGE * ((att**2).sum() + (dfc**2).sum()), -gradient


def _statistics(matches: DataFrame, as_of: Column | None, half_life: float, **names: str) -> Statistics:
    if as_of is None:
        as_of = F.lit(matches.agg(F.max(F.to_date(names.get("date", "Date")))).first()[0])
    return Statistics(sufficient_statistics(matches, as_of, half_life, **names))


def _optimum(stats: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """(parameters of least objective, matches of each team)."""
    n = stats.n
    mean, games = stats.goals_and_games()
    x = np.zeros(2 * n + 3)
    x[2 * n], x[2 * n + 1] = 0.25, np.log(max(mean, 0.1))
    low, high = (np.array([BOUNDS["team"][i]] * (2 * n) + [BOUNDS[k][i] for k in ("advantage", "base", "rho")]) for i in (0, 1))
    return minimise(stats.objective, np.clip(x, low, high), low, high), games


def fit(matches: DataFrame, as_of: Column | None = None, half_life: float = 260.0, **names: str) -> ScoreModel:
    """Fits, centres (prediction-neutral) and shrinks sparse teams' attack and defence by n / (n + 3)."""
    stats = _statistics(matches, as_of, half_life, **names)
    n, teams = stats.n, stats.teams
    if not n:
        return ScoreModel({}, {}, 0.25, 0.0, 0.0)
    x, games = _optimum(stats)
    att, dfc = x[:n] - x[:n].mean(), x[n : 2 * n] - x[n : 2 * n].mean()
    base = x[2 * n + 1] + x[:n].mean() - x[n : 2 * n].mean()
    shrink = games / (games + SHRINK)
    return ScoreModel(dict(zip(teams, (att * shrink).tolist(), strict=True)), dict(zip(teams, (dfc * shrink).tolist(), strict=True)), float(x[2 * n]), float(base), float(x[2 * n + 2]))


def balance(matches: DataFrame, as_of: Column | None = None, half_life: float = 260.0, **names: str) -> DataFrame:
    """(team, scored, conceded): weighted goals that the fitted likelihood, its penalty included, expects of each team.

    At the optimum these are the team's own weighted goals; what they miss those by is the objective's slope.
    """
    stats = _statistics(matches, as_of, half_life, **names)
    n, spark = stats.n, stats.spark
    if not n:
        return spark.createDataFrame([], "team string, scored double, conceded double")
    x, _ = _optimum(stats)
    slope = stats.objective(x)[1]
    rows = sufficient_statistics(matches, as_of if as_of is not None else F.lit(matches.agg(F.max(F.to_date(names.get("date", "Date")))).first()[0]), half_life, **names).filter("home is not null and away is not null and hg is not null and ag is not null")
    side = lambda t, f, g: F.struct(F.col(t).alias("team"), (F.col("w") * F.col(f)).alias("f"), (F.col("w") * F.col(g)).alias("g"))
    own = rows.select(F.explode(F.array(side("home", "hg", "ag"), side("away", "ag", "hg"))).alias("s")).groupBy("s.team").agg(F.sum("s.f").alias("f"), F.sum("s.g").alias("g"))
    missed = spark.createDataFrame([(t, float(slope[i]), float(slope[n + i])) for i, t in enumerate(stats.teams)], f"team {dict(rows.dtypes)['home']}, ds double, dc double")
    return own.join(missed, "team").select("team", (F.col("f") + F.col("ds")).alias("scored"), (F.col("g") - F.col("dc")).alias("conceded"))


def log_likelihood(matches: DataFrame, model: ScoreModel, as_of: Column, half_life: float = 260.0, **names: str) -> float:
    """The fitted model's weighted log-likelihood (constants and penalty aside), from the same statistics."""
    s = Statistics(sufficient_statistics(matches, as_of, half_life, **names))
    x = np.array([model.attack.get(t, 0.0) for t in s.teams] + [model.defence.get(t, 0.0) for t in s.teams] + [model.advantage, model.base, model.rho])
    value, _ = s.objective(x)
    return -(value - RIDGE * (x[: 2 * s.n] ** 2).sum())
