"""Probability expressions.  Outcomes are always in the order H, D, A."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("H", "D", "A")


def result(home_goals: Column, away_goals: Column) -> Column:
    """H, A or D; null if a side's goals are."""
    return F.when(home_goals > away_goals, "H").when(home_goals < away_goals, "A").when(home_goals == away_goals, "D")


def argmax_label(h: Column, d: Column, a: Column) -> Column:
    """The most probable outcome; ties go to the earlier in H, D, A."""
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalised(cols: list[Column], low: float, high: float | None = None) -> list[Column]:
    """Clipped and divided by their sum."""
    kept = [clip(c, low, high) if high is not None else F.greatest(c, F.lit(low)) for c in cols]
    total = sum(kept[1:], kept[0])
    return [c / total for c in kept]


def poisson(rate: Column, k: int) -> Column:
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / F.lit(float(math.factorial(k)))


def confidence(h: Column, d: Column, a: Column, high: float = 0.30, medium: float = 0.15) -> Column:
    """High, Medium or Low by the gap of the two largest probabilities."""
    by_size = F.sort_array(F.array(h, d, a), asc=False)
    gap = by_size[0] - by_size[1]
    return F.when(gap >= high, "High").when(gap >= medium, "Medium").otherwise("Low")
