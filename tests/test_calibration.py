"""Calibration curves against plain fits over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pitchline.operators import ensemble


def pooled(points):
    """Plain pool-adjacent-violators over (value, label)."""
    blocks = []
    for x in sorted({x for x, _ in points}):
        ys = [y for v, y in points if v == x]
        blocks.append([x, x, sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "few"])
def test_isotonic_blocks_merge_to_the_plain_curve(spark, kind):
    rng = random.Random(6)
    chance = {"noise": lambda x: x, "falling": lambda x: 1 - x, "rising": lambda x: float(x > 0.5), "few": lambda x: 0.5}[kind]
    points = [(rng.choice((0.25, 0.5)) if kind == "few" else round(rng.random(), 3), 0) for _ in range(1500)]
    points = [(x, int(rng.random() < chance(x))) for x, _ in points]
    df = spark.createDataFrame([(x, "H" if y else "A") for x, y in points] + [(None, "H")], "p_h double, y string")
    got = sorted(tuple(r)[:4] for r in ensemble.fit_isotonic(df, "p_h", "H").collect())
    assert got == pooled(points)
    assert got == sorted(tuple(r)[:4] for r in ensemble.fit_isotonic(df, "p_h", "H", ranges=1).collect())
    values = [r["value"] for r in ensemble.fit_isotonic(df, "p_h", "H", ranges=5, fewer=2).orderBy("low").collect()]
    assert all(a < b for a, b in zip(values, values[1:], strict=False))


def test_no_rows_no_curve(spark):
    empty = spark.createDataFrame([], "p_h double, p_d double, p_a double, y string")
    assert ensemble.fit_isotonic(empty, "p_h", "H").count() == 0
    assert ensemble.fit_platt(empty).slope == (0.0, 0.0, 0.0)


def test_platt_equals_a_fit_on_all_rows(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.dirichlet([3, 2, 2], 3000), 9)
    y = ["HDA"[rng.choice(3, p=q / q.sum())] for q in p]
    df = spark.createDataFrame([(*map(float, q), k) for q, k in zip(p, y, strict=True)] + [(None, 0.5, 0.5, "D")], "p_h double, p_d double, p_a double, y string")
    m = ensemble.fit_platt(df)
    p, y = np.vstack([p, [np.nan, 0.5, 0.5]]), [*y, "D"]
    for i, k in enumerate("HDA"):
        there = ~np.isnan(p[:, i])
        z, t = np.stack([p[there, i], np.ones(there.sum())], axis=1), np.array([c == k for c in y], float)[there]
        w = np.zeros(2)
        for _ in range(60):
            q = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag([1.0, 1e-9]), z.T @ (t - q) - [w[0], 0])
        assert abs(m.slope[i] - w[0]) < 1e-8 and abs(m.intercept[i] - w[1]) < 1e-8
