"""Blending models and calibrating the blend, as column arithmetic over small parameter tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import OUTCOMES, normalised
from ..plans.lineage import cut

P = ("p_h", "p_d", "p_a")


def log_loss_weights(reports: DataFrame, temperature: float = 1.0, model: str = "model") -> DataFrame:
    """(model, weight): softmax of the negative log loss; a row a model."""
    w = Window.partitionBy()
    x = -F.col("log_loss") / temperature
    e = reports.select(model, x.alias("x")).withColumn("e", F.exp(F.col("x") - F.max("x").over(w)))
    return e.select(model, (F.col("e") / F.sum("e").over(w)).alias("weight"))


def blend(predictions: DataFrame, weights: DataFrame, key: str, model: str = "model") -> DataFrame:
    """(key, p_h, p_d, p_a): weighted sum over the models that a row and ``weights`` share, clipped and normalised."""
    j = predictions.join(F.broadcast(weights), model)  # a row a model
    sums = j.groupBy(key).agg(*[F.sum(F.col("weight") * F.col(p)).alias(p) for p in P])
    return sums.select(key, *[c.alias(p) for c, p in zip(normalised([F.col(p) for p in P], 1e-9), P, strict=True)])


@dataclass
class Platt:
    """Slope and intercept of each outcome's logistic curve."""

    slope: tuple[float, float, float]
    intercept: tuple[float, float, float]

    def columns(self, cols: tuple[str, str, str] = P) -> list[Column]:
        raw = [1 / (1 + F.exp(-(F.col(c) * a + b))) for c, a, b in zip(cols, self.slope, self.intercept, strict=True)]
        return normalised(raw, 1e-6, 1 - 1e-6)

    def apply(self, df: DataFrame) -> DataFrame:
        out = dict(zip(P, self.columns(), strict=True))
        return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def fit_platt(df: DataFrame, rounds: int = 50) -> Platt:
    """One-dimensional ridge logistic regressions (penalty w ** 2 / 2) of each outcome on its probability, over all rows.

    Each Newton step is one aggregation: slope and curvature of the three objectives, fifteen sums.  Rows without a
    probability count for the other outcomes alone.
    """
    rows = cut(df.select(*P, "y"))
    w, open_ = np.zeros((3, 2)), [0, 1, 2]
    for _ in range(rounds):
        sums = []
        for k in open_:
            p, (slope, intercept) = F.col(P[k]), w[k].tolist()
            q = 1 / (1 + F.exp(-(p * slope + intercept)))
            gap, wide = F.coalesce((F.col("y") == OUTCOMES[k]).cast("double"), F.lit(0.0)) - q, q * (1 - q)
            sums += [F.sum(F.when(p.isNotNull(), x)) for x in (p * gap, gap, p * p * wide, p * wide, wide)]
        got = np.array([x or 0.0 for x in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]).reshape(-1, 5)
        moved = []
        for k, (g0, g1, h00, h01, h11) in zip(open_, got, strict=True):
            step = np.linalg.solve([[h00 + 1.0, h01], [h01, h11 + 1e-9]], [g0 - w[k, 0], g1])
            w[k] += step
            if np.abs(step).max() >= 1e-10:
                moved.append(k)
        open_ = moved
        if not open_:
            break
    return Platt(tuple(w[:, 0].tolist()), tuple(w[:, 1].tolist()))


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their values, neighbours pooled as long as the earlier one's mean isn't the lower."""
    blocks: list[list] = []
    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in _BLOCK), strict=True):
            blocks.append(list(block))
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:  # whole numbers: exact
                _, high, hits, n = blocks.pop()
                blocks[-1][1:] = high, blocks[-1][2] + hits, blocks[-1][3] + n
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True) if blocks else [[]] * 4, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=list(_BLOCK))


_BLOCK = ("low", "high", "hits", "n")


def fit_isotonic(df: DataFrame, p: str, outcome: str, ranges: int = 64, fewer: int = 16) -> DataFrame:
    """(low, high, hits, n, value): the non-decreasing calibration curve of least squares, as blocks of equal value.

    Rows are summed by probability, pooled within ranges of it, and the blocks of neighbouring ranges are pooled again in
    ever fewer ranges; pooling blocks instead of rows changes nothing.  The last task sees blocks, not rows.  Rows without a
    probability don't count; no rows give no blocks.
    """
    rows = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("low")).agg(F.count_if(F.col("y") == outcome).alias("hits"), F.count("*").alias("n"))
    blocks = rows.select("low", F.col("low").alias("high"), "hits", "n")
    while True:
        blocks = cut(blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low").mapInArrow(_pool, "low double, high double, hits long, n long"))
        if ranges == 1:
            return blocks.select(*_BLOCK, (F.col("hits") / F.col("n")).alias("value"))
        ranges = max(1, ranges // fewer)
