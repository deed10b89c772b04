"""The classifier registry on Spark ML, and training on top of it.

Missing values are imputed with exact medians of the training rows; the standardisation uses the
population deviation.  Boosted trees are one-versus-rest gradient-boosted trees; the three
third-party boosting libraries aren't part of Spark: their entries count as available where their Spark packages are installed
(not tested here, as none is).
"""

from __future__ import annotations

import importlib.util
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model as MLModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import outcome_index
from ..operators.quantiles import exact_quantiles
from . import trees as grown

DENY = ("MatchID", "Season", "SeasonStartYear", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "Referee", "split")
DENY_PREFIX = ("Fuzzy_", "Poisson_")
SEED = 42

#: Training rows of one task of a tree's job, about.
TASK_ROWS = 20_000


def feature_columns(df: DataFrame, deny: tuple[str, ...] = DENY, prefixes: tuple[str, ...] = DENY_PREFIX, groups: tuple[str, ...] = ()) -> list[str]:
    """Columns that may be features: all but keys, outcomes and model outputs; ``groups``: parts of names to leave out, such as xG."""
    return [c for c in df.columns if c not in deny and not c.startswith(prefixes) and not any(g in c for g in groups)]


def with_values(train: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have a value in training rows, by one aggregation."""
    if not columns:
        return []
    n = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if n[c]]


def _value(c: str) -> Column:
    """A feature as a number; NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


@dataclass
class Preparation:
    """Medians, means and deviations of the training rows."""

    columns: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]

    def apply(self, df: DataFrame, scale: bool, label: str | None = None) -> DataFrame:
        filled = {c: F.coalesce(_value(c), F.lit(self.median[c])) for c in self.columns}
        if scale:
            filled = {c: (v - self.mean[c]) / self.deviation[c] for c, v in filled.items()}
        out = df.select(*[F.col(c) for c in df.columns if c not in filled], *[v.alias(c) for c, v in filled.items()])
        if label:
            out = out.withColumn("label", outcome_index(F.col(label)).cast("double"))
        return VectorAssembler(inputCols=self.columns, outputCol="features").transform(out)


def prepare(train: DataFrame, columns: list[str]) -> Preparation:
    median = {c: q[0] if q else 0.0 for c, q in exact_quantiles(train.select(*[_value(c).alias(c) for c in columns]), columns, (0.5,)).items()}
    filled = train.select(*[F.coalesce(_value(c), F.lit(median[c])).alias(c) for c in columns])
    m = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return Preparation(columns, median, {c: float(m[f"m_{c}"] or 0) for c in columns}, {c: float(m[f"s_{c}"] or 0) or 1.0 for c in columns})


def sample_deviation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    r = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: float(r[c]) for c in columns if r[c] is not None}


@dataclass
class Entry:
    """A registry entry: how to build its estimator for n rows, whether it wants scaled features, whether it can run here."""

    build: Callable[[int], object]
    scaled: bool
    available: bool = True


def _xgboost(n: int):
    from xgboost.spark import SparkXGBClassifier

    return SparkXGBClassifier(n_estimators=100, max_depth=4, learning_rate=0.05, subsample=0.8, random_state=SEED)


def _synapse(n: int):
    from synapse.ml.lightgbm import LightGBMClassifier

    return LightGBMClassifier(objective="multiclass", numIterations=100, maxDepth=4, learningRate=0.05, seed=SEED)


def _catboost(n: int):
    from catboost_spark import CatBoostClassifier

    return CatBoostClassifier(iterations=100, depth=4, learningRate=0.05, randomSeed=SEED)


def registry(trees: int = 400, boosts: int = 100) -> dict[str, Entry]:
    boosted = lambda depth, bins: grown.Boosting(boosts, depth, bins, step=0.05, share=0.8, seed=SEED)
    there = lambda name: importlib.util.find_spec(name) is not None
    return {
        "LogisticRegression": Entry(lambda n: LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=300), True),
        "RandomForest": Entry(lambda n: grown.Forest(trees, depth=8, least=5, seed=SEED), False),
        "BoostedTrees": Entry(lambda n: boosted(4, 32), False),
        "BoostedTreesShallow": Entry(lambda n: boosted(3, 64), False),
        "XGBoost": Entry(_xgboost, False, there("xgboost")), "LightGBM": Entry(_synapse, False, there("synapse")), "CatBoost": Entry(_catboost, False, there("catboost_spark")),
    }


def availability(entries: dict[str, Entry]) -> list[tuple[str, bool]]:
    return [(k, e.available) for k, e in entries.items()]


@dataclass
class Fitted:
    name: str
    model: MLModel
    preparation: Preparation
    scaled: bool

    def probabilities(self, df: DataFrame, key: str) -> DataFrame:
        """(key, model, p_h, p_d, p_a); a class the training rows lacked has 0."""
        rows = self.preparation.apply(df, self.scaled).select(key, "features")
        if isinstance(self.model, grown.TreesModel):
            parts = self.model.probabilities(rows, key)
            cols = [F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) for i in range(3)]
        else:
            parts = self.model.transform(rows)
            p = vector_to_array("probability")
            cols = [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3)]
        return parts.select(key, F.lit(self.name).alias("model"), *[c.alias(n) for c, n in zip(cols, ("p_h", "p_d", "p_a"), strict=True)])

    def importances(self) -> dict[str, float]:
        v = getattr(self.model, "featureImportances", None)
        return dict(zip(self.preparation.columns, v.toArray().tolist(), strict=True)) if v is not None else {}


def fit_all(train: DataFrame, columns: list[str], label: str = "FTR", entries: dict[str, Entry] | None = None) -> dict[str, Fitted]:
    """Every available entry fitted to the training rows; unavailable ones are left out.

    Entries are fitted side by side: boosting is a long chain of short jobs, which alone leave most cores idle.  Trees share their
    rows, held in partitions of about TASK_ROWS, and those with equally many bins their coded blocks; the regression keeps blocks of its own.
    """
    prep = prepare(train, columns)
    n = train.count()
    data = {s: prep.apply(train, s, label).select("features", "label").filter("label is not null") for s in (True, False)}
    data[False] = data[False].coalesce(max(1, math.ceil(n / TASK_ROWS))).persist()
    chosen = {k: e for k, e in (entries or registry()).items() if e.available}
    built = {k: e.build(n) for k, e in chosen.items()}
    bins = {e.bins for e in built.values() if isinstance(e, (grown.Boosting, grown.Forest))}
    thread = inheritable_thread_target(train.sparkSession)
    with ThreadPoolExecutor(max(1, len(chosen) + len(bins))) as pool:
        coded = {b: pool.submit(thread(grown.Coded), data[False], b) for b in bins}
        fit = lambda k: built[k].fit(data[chosen[k].scaled], *([coded[b].result()] if (b := getattr(built[k], "bins", None)) in coded else []))
        fitted = dict(zip(chosen, pool.map(thread(fit), chosen), strict=True))
    for c in coded.values():
        c.result().blocks.unpersist()
    data[False].unpersist()
    return {k: Fitted(k, fitted[k], prep, e.scaled) for k, e in chosen.items()}
