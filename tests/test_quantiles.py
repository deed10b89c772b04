"""Quantiles by narrowing histograms equal the ones that keep every value."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pitchline.operators.quantiles import exact_quantiles

AT = (0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.99, 1.0)


def same(a, b):
    return (a is None) == (b is None) and (a is None or all((math.isnan(x) and math.isnan(y)) or x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True)))


@pytest.mark.parametrize("ranges", [32, 1024])
def test_equals_percentile(spark, ranges):
    rng = random.Random(3)
    n = 2000
    columns = {
        "even": [rng.random() for _ in range(n)], "counts": [float(rng.randint(0, 5)) for _ in range(n)], "tail": [math.exp(rng.gauss(0, 20)) for _ in range(n)], "signs": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(n)],
        "wide": [rng.choice((-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1.0)) for _ in range(n)], "holes": [None if rng.random() < 0.6 else rng.random() for _ in range(n)], "none": [None] * n, "one": [7.0] + [None] * (n - 1), "same": [2.5] * n,
        "odd": [rng.choice((math.nan, math.inf, -math.inf, 1.0, 2.0, None)) for _ in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns))
    want = df.agg(*[F.percentile(c, list(AT)).alias(c) for c in columns]).first()
    got = exact_quantiles(df, list(columns), AT, ranges)
    assert list(got) == list(columns)
    assert [c for c in columns if not same(got[c], want[c])] == []


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "3", 2)], "value int, column string, name int")
    assert exact_quantiles(df, ["value", "column", "name"], (0.5,)) == {"value": [1.0], "column": [3.0], "name": [2.0]}
    assert exact_quantiles(df.limit(0), ["value"], (0.5,)) == {"value": None} and exact_quantiles(df, [], (0.5,)) == {}
