"""The likelihood summed in Spark and on the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.operators.scores import sufficient_statistics
from pitchline.plans import score_fit
from tests.test_operators import league


@pytest.mark.parametrize("joined", [False, True])
def test_value_and_gradient_are_the_driver_s(spark, monkeypatch, joined):
    m = league(spark, 2, 6).withColumn("FTHG", F.when(F.rand(3) > 0.02, F.col("FTHG")))
    stats = sufficient_statistics(m, F.lit("2016-12-01").cast("date"))
    here = score_fit.Statistics(stats)
    monkeypatch.setattr(score_fit, "MOST_ROWS", 0)
    monkeypatch.setattr(score_fit, "BROADCAST_TEAMS", 0 if joined else 100)
    there = score_fit.Statistics(stats)
    assert here.here and not there.here and here.teams == there.teams
    rng = np.random.default_rng(2)
    for rho in (-0.2, 0.0, 0.3):
        x = np.concatenate([rng.normal(0, 0.5, 2 * here.n), [0.2, 0.1, rho]])
        (v, g), (w, k) = here.objective(x), there.objective(x)
        assert abs(v - w) < 1e-8 * abs(v) and np.abs(g - k).max() < 1e-8 * max(1, np.abs(g).max())
    (mean, games), (mean2, games2) = here.goals_and_games(), there.goals_and_games()
    assert abs(mean - mean2) < 1e-12 and (games == games2).all()


def test_the_optimum_is_the_same(spark, monkeypatch):
    m = league(spark, 1, 4)
    want = score_fit.fit(m)
    likelihood = score_fit.log_likelihood(m, want, F.lit("2016-01-01").cast("date"))
    monkeypatch.setattr(score_fit, "MOST_ROWS", 0)
    got = score_fit.fit(m)
    for a, b in ((want.attack, got.attack), (want.defence, got.defence)):
        assert all(abs(a[t] - b[t]) < 1e-6 for t in a) and a.keys() == b.keys()
    assert max(abs(want.advantage - got.advantage), abs(want.base - got.base), abs(want.rho - got.rho)) < 1e-6
    assert abs(score_fit.log_likelihood(m, want, F.lit("2016-01-01").cast("date")) - likelihood) < 1e-8 * abs(likelihood)
    assert score_fit.fit(m.limit(0)).attack == {}
