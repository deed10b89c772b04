"""Rule-based (Mamdani) inference over batches of rows.

Membership functions and rules are data; a rule's strength is a minimum of memberships, an output term's a
maximum over rules, and the centroid is a closed sum.  All are array operations over an Arrow batch: as
column expressions the rule base outgrows what the JVM compiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .metrics import goals_sanity

#: Universes (low, high, step), terms as trapezoids (a triangle repeats its peak), and the rules.
UNIVERSES = {"Form": (0, 1, 0.01), "Attack": (0, 4.5, 0.05), "Defense": (0, 4.5, 0.05), "HomeAdvantage": (0, 1, 0.01), "Fatigue": (0, 1, 0.01), "TeamStrength": (1200, 1950, 5), "StrengthGap": (-600, 600, 10), "FormGap": (-1, 1, 0.02)}
TERMS = {
    "Form": {"VeryPoor": (0, 0, 0.12, 0.28), "Poor": (0.15, 0.33, 0.33, 0.50), "Average": (0.33, 0.50, 0.50, 0.67), "Good": (0.50, 0.67, 0.67, 0.85), "VeryGood": (0.72, 0.85, 1, 1)},
    "Attack": {"Weak": (0, 0, 0.8, 1.2), "Average": (0.9, 1.4, 1.4, 1.9), "Strong": (1.6, 2.1, 4.5, 4.5)},
    "Defense": {"Strong": (0, 0, 0.8, 1.2), "Average": (0.9, 1.4, 1.4, 1.9), "Weak": (1.6, 2.1, 4.5, 4.5)},
    "HomeAdvantage": {"Low": (0, 0, 0.30, 0.45), "Medium": (0.35, 0.55, 0.55, 0.75), "High": (0.65, 0.80, 1, 1)},
    "Fatigue": {"Low": (0, 0, 0.25, 0.40), "Medium": (0.30, 0.50, 0.50, 0.70), "High": (0.60, 0.75, 1, 1)},
    "TeamStrength": {"Weak": (1200, 1200, 1420, 1480), "Average": (1440, 1525, 1525, 1610), "Strong": (1570, 1650, 1950, 1950)},
    "StrengthGap": {"AwayMuchStronger": (-600, -600, -250, -150), "AwayStronger": (-220, -110, -110, 0), "Similar": (-120, 0, 0, 120), "HomeStronger": (0, 110, 110, 220), "HomeMuchStronger": (150, 250, 600, 600)},
    "FormGap": {"AwayFormMuchBetter": (-1, -1, -0.5, -0.3), "AwayFormBetter": (-0.45, -0.22, -0.22, 0), "FormSimilar": (-0.25, 0, 0, 0.25), "HomeFormBetter": (0, 0.22, 0.22, 0.45), "HomeFormMuchBetter": (0.3, 0.5, 1, 1)},
}
OUTPUT_TERMS = {"Low": (0, 0, 25, 50), "Medium": (25, 50, 50, 75), "High": (50, 75, 100, 100)}
OUTPUTS = {n: n for n in ("HomeWin", "Draw", "AwayWin", "HomeGoals", "AwayGoals", "Over25", "Under25")}
RULES = """
StrengthGap=HomeMuchStronger > HomeWin=High Draw=Low AwayWin=Low
StrengthGap=HomeStronger > HomeWin=Medium Draw=Medium AwayWin=Low
StrengthGap=Similar > HomeWin=Medium Draw=Medium AwayWin=Low
StrengthGap=AwayStronger > HomeWin=Low Draw=Medium AwayWin=Medium
StrengthGap=AwayMuchStronger > HomeWin=Low Draw=Low AwayWin=High
FormGap=HomeFormMuchBetter > HomeWin=High Draw=Low AwayWin=Low
FormGap=HomeFormBetter > HomeWin=Medium Draw=Medium AwayWin=Low
FormGap=FormSimilar > HomeWin=Medium Draw=Medium AwayWin=Low
FormGap=AwayFormBetter > HomeWin=Low Draw=Medium AwayWin=Medium
FormGap=AwayFormMuchBetter > HomeWin=Low Draw=Low AwayWin=High
HomeAdvantage=High HomeForm=Good > HomeWin=High
HomeAdvantage=High StrengthGap=Similar > HomeWin=Medium
HomeAdvantage=Low AwayForm=Good > AwayWin=Medium
HomeAdvantage=Low AwayStrength=Strong > AwayWin=High
HomeAdvantage=Medium StrengthGap=Similar > Draw=High
HomeFatigue=High AwayFatigue=Low > AwayWin=Medium
AwayFatigue=High HomeFatigue=Low > HomeWin=Medium
HomeFatigue=High HomeStrength=Strong > HomeWin=Medium
AwayFatigue=High AwayStrength=Strong > AwayWin=Medium
HomeFatigue=High AwayFatigue=High > Under25=Medium
HomeStrength=Weak AwayStrength=Weak > Draw=Medium
HomeStrength=Strong AwayStrength=Strong > Draw=Medium
HomeStrength=Strong HomeForm=VeryGood > HomeWin=High
AwayStrength=Strong AwayForm=VeryGood > AwayWin=High
HomeStrength=Weak HomeForm=VeryPoor > AwayWin=Medium
AwayStrength=Weak AwayForm=VeryPoor > HomeWin=Medium
HomeAttack=Strong AwayDefense=Weak > HomeGoals=High
HomeAttack=Weak AwayDefense=Strong > HomeGoals=Low
AwayAttack=Strong HomeDefense=Weak > AwayGoals=High
AwayAttack=Weak HomeDefense=Strong > AwayGoals=Low
HomeAttack=Average AwayDefense=Average > HomeGoals=Medium
AwayAttack=Average HomeDefense=Average > AwayGoals=Medium
HomeAttack=Strong AwayDefense=Average > HomeGoals=Medium
AwayAttack=Strong HomeDefense=Average > AwayGoals=Medium
HomeForm=VeryGood HomeAttack=Strong > HomeGoals=High
AwayForm=VeryGood AwayAttack=Strong > AwayGoals=High
HomeAttack=Strong AwayAttack=Strong HomeDefense=Weak AwayDefense=Weak > Over25=High Under25=Low
HomeDefense=Strong AwayDefense=Strong HomeAttack=Weak AwayAttack=Weak > Under25=High Over25=Low
HomeDefense=Weak AwayDefense=Weak > Over25=High
HomeAttack=Strong AwayDefense=Weak > Over25=Medium
AwayAttack=Strong HomeDefense=Weak > Over25=Medium
HomeDefense=Strong AwayDefense=Strong > Under25=Medium
HomeAttack=Weak AwayAttack=Weak > Under25=Medium
HomeAttack=Weak AwayDefense=Strong > Over25=Low
AwayAttack=Weak HomeDefense=Strong > Over25=Low
HomeAttack=Average AwayAttack=Average > Over25=Medium Under25=Medium
"""


def rules() -> list[tuple[list[tuple[str, str]], list[tuple[str, str]]]]:
    """(antecedents, consequents) as (variable, term) pairs."""
    pairs = lambda s: [tuple(x.split("=")) for x in s.split()]
    return [(pairs(a), pairs(b)) for a, b in (line.split(">") for line in RULES.strip().splitlines())]


def kind_of(variable: str) -> str:
    """The universe of a variable: HomeForm and AwayForm share Form, strengths share TeamStrength."""
    if variable in UNIVERSES:
        return variable
    bare = variable.removeprefix("Home").removeprefix("Away")
    return "TeamStrength" if bare == "Strength" else bare


def trapezoid(x: np.ndarray, shape: tuple[float, float, float, float]) -> np.ndarray:
    """Membership of ``x`` in a trapezoid; equal corners on a side mean that it starts at full height."""
    a, b, c, d = map(float, shape)
    up = np.ones_like(x) if a == b else (x - a) / (b - a)
    down = np.ones_like(x) if c == d else (d - x) / (d - c)
    return np.where((x < a) | (x > d), 0.0, np.where(x < b, up, np.where(x <= c, 1.0, down)))


def on_grid(shape: tuple[float, float, float, float], universe: tuple[float, float, float]) -> bool:
    """Whether all corners are grid points, where interpolation on the grid is exact."""
    low, _, step = universe
    return all(abs((v - low) / step - round((v - low) / step)) < 1e-9 for v in shape)


def membership(x: np.ndarray, kind: str, term: str) -> np.ndarray:
    """Membership of ``x``, clipped to the universe, read off the sampled function by linear interpolation; NaN: 0."""
    low, high, step = UNIVERSES[kind]
    shape = TERMS[kind][term]
    x = np.clip(x, low, high)
    if on_grid(shape, UNIVERSES[kind]):
        out = trapezoid(x, shape)
    else:
        at = np.floor((x - low) / step)
        left, right = trapezoid(at * step + low, shape), trapezoid(np.minimum((at + 1) * step + low, high), shape)
        out = left + (right - left) * ((x - low) / step - at)
    return np.where(np.isnan(x), 0.0, out)


def fatigue(rest_days: Column, recent: Column) -> Column:
    """0.6 times short rest plus 0.4 times many recent matches; a missing part counts 0.3 and 0.2 of its weight."""
    # least() and greatest() pass over nulls, so missing parts are told apart first
    rest = 0.6 * (1 - F.least(F.greatest(rest_days.cast("double"), F.lit(0.0)), F.lit(14.0)) / 14)
    load = 0.4 * F.least(F.greatest(recent.cast("double"), F.lit(0.0)), F.lit(4.0)) / 4
    return F.when(rest_days.isNotNull(), rest).otherwise(0.6 * 0.3) + F.when(recent.isNotNull(), load).otherwise(0.4 * 0.2)


def crisp_inputs(df: DataFrame) -> DataFrame:
    """Adds the rules' variables, from the feature columns with their defaults."""
    have = lambda c, d: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(d))) if c in df.columns else F.lit(float(d))
    raw = lambda c: F.col(c) if c in df.columns else F.lit(None)
    out = {"HomeAdvantage": have("Home_VenueResult_L5", 0.5)}
    for s in ("Home", "Away"):
        out |= {f"{s}Form": have(f"{s}_Result_L5", 0.5), f"{s}Attack": have(f"{s}_GF_L10", 1.4), f"{s}Defense": have(f"{s}_GA_L10", 1.4), f"{s}Strength": have(f"{s}EloPre", 1500), f"{s}Fatigue": fatigue(raw(f"{s}_RestDays"), raw(f"{s}_MatchesLast14Days"))}
    df = df.select("*", *[c.alias(f"_{k}") for k, c in out.items()])
    return df.select("*", (F.col("_HomeStrength") - F.col("_AwayStrength")).alias("_StrengthGap"), (F.col("_HomeForm") - F.col("_AwayForm")).alias("_FormGap"))


#: Points between two corners of neighbouring output terms.
STRETCH = 25


def _meeting(falling: np.ndarray, rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over points i = 1..24 of the larger of two clipped terms, and the sum weighted by i: arithmetic series between three cuts.

    Up to n the falling term is larger, up to k it is cut off at its strength, up to q the rising one isn't.
    """
    last = STRETCH - 1
    cross = np.ceil(np.minimum(STRETCH * falling, STRETCH / 2))
    cross = np.where(falling <= rising, cross, np.maximum(cross, np.ceil(STRETCH * (1 - rising))))
    n = np.clip(cross - 1, 0, last)
    k = np.minimum(np.clip(np.floor(STRETCH * (1 - falling)), 0, last), n)
    q = np.minimum(np.maximum(np.floor(STRETCH * rising), n), last)
    one = lambda x: x * (x + 1) / 2
    two = lambda x: x * (x + 1) * (2 * x + 1) / 6
    area = falling * k + (n - k) - (one(n) - one(k)) / STRETCH + (one(q) - one(n)) / STRETCH + rising * (last - q)
    moment = falling * one(k) + (one(n) - one(k)) - (two(n) - two(k)) / STRETCH + (two(q) - two(n)) / STRETCH + rising * (one(last) - one(q))
    return area, moment


def centroid(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Centroid of the clipped output terms on 0..100: points where one term stands alone, and the two stretches where two meet; 50 without any."""
    left, left_moment = _meeting(low, mid)
    right, right_moment = _meeting(mid, high)
    area = low * 26 + mid + high * 26 + left + right
    moment = low * sum(range(26)) + mid * 50 + high * sum(range(75, 101)) + left_moment + 25 * left + right_moment + 50 * right
    return np.where(area > 0, moment / np.maximum(area, 1e-300), 50.0)


def potentials(variables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each output's potential from the rules' variables: memberships, strengths of the rules, centroids."""
    member = {(v, t): membership(variables[v], kind_of(v), t) for v, t in {p for a, _ in rules() for p in a}}
    strength: dict[tuple[str, str], np.ndarray] = {}
    for before, after in rules():
        fired = np.minimum.reduce([member[p] for p in before])
        for then in after:
            strength[then] = np.maximum(strength[then], fired) if then in strength else fired
    none = np.zeros_like(next(iter(variables.values())))
    return {o: centroid(*[strength.get((o, t), none) for t in OUTPUT_TERMS]) for o in OUTPUTS}


def _infer(variables: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {v: batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i, v in enumerate(variables)}
            p = {OUTPUTS[o]: v for o, v in potentials(x).items()}
            three, two = p["HomeWin"] + p["Draw"] + p["AwayWin"], p["Over25"] + p["Under25"]
            share = lambda a, total, other: np.where(total > 0, a / np.where(total > 0, total, 1), other)
            chances = [share(p[n], three, 1 / 3) for n in ("HomeWin", "Draw", "AwayWin")] + [share(p[n], two, 0.5) for n in ("Over25", "Under25")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, [*p.values(), *chances])], names=[batch.schema.names[0], *_COLUMNS])

    return run


_COLUMNS = [f"Fuzzy_{n}Potential" for n in OUTPUTS.values()] + [f"Fuzzy_P_{n}" for n in ("HomeWin", "Draw", "AwayWin", "Over25", "Under25")]


def infer(df: DataFrame, key: str = "MatchID") -> DataFrame:
    """(key, 7 potentials from 0 to 100, 5 probabilities): inference over a table of feature rows, a batch at a time."""
    variables = sorted({v for a, _ in rules() for v, _ in a})
    rows = crisp_inputs(df).select(F.col(key), *[F.col(f"_{v}").cast("double").alias(f"_{v}") for v in variables])
    shape = StructType([rows.schema.fields[0], *StructType.fromDDL(", ".join(f"{c} double" for c in _COLUMNS)).fields])
    return rows.mapInArrow(_infer(variables), shape)


def with_outcomes(matches: DataFrame, outputs: DataFrame, key: str = "MatchID") -> DataFrame:
    """Inference beside what happened: the outputs of the matches that are in both tables, each once (one row a key on either side)."""
    return matches.select(key, "FTR", "FTHG", "FTAG").join(outputs, key)


def sanity(merged: DataFrame) -> DataFrame:
    """How far inference tells matches apart: hit rates of the likeliest outcome and of more than 2.5 goals, mean home chance by outcome."""
    chances = {f"p_{x}": F.col(f"Fuzzy_P_{n}") for x, n in (("h", "HomeWin"), ("d", "Draw"), ("a", "AwayWin"), ("over", "Over25"))}
    return goals_sanity(merged.select(F.col("FTR").alias("y"), (F.col("FTHG") + F.col("FTAG")).alias("goals"), *[c.alias(n) for n, c in chances.items()]))
