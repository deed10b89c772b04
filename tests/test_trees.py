from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from pitchline.plans import models, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, (2, 5, 20), (600, 3))
    y = (x[:, 0] + (x[:, 1] > 2) * (x[:, 2] > 9) + (rng.random(600) < 0.1)) % 3
    df = spark.createDataFrame([(i, *map(float, r), float(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(3)).select("id", "features", "label").persist()


def _p(df, key="id"):
    return np.array([r["p"] for r in df.orderBy(key).collect()])


def test_a_level_of_all_classes_is_one_job(spark, rows):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    fits = []
    for boosts in (1, 5):
        before = jobs()
        models.registry(boosts=boosts)["BoostedTrees"].build(600).fit(rows.select("features", "label"))
        fits.append(jobs() - before)
    assert fits[1] - fits[0] <= 4 * 4  # four more rounds of four levels


def test_boosting_is_that_of_spark_ml(rows):
    own = trees.Boosting(4, 3, 32, step=0.3, share=1.0).fit(rows)
    ml = OneVsRest(classifier=GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3, maxBins=32)).fit(rows.select("features", "label"))
    cols = [vector_to_array("probability")[1]]
    each = np.stack([np.array([r[1] for r in m.transform(rows).select("id", cols[0]).orderBy("id").collect()]) for m in ml.models], axis=1)
    assert np.abs(_p(own.probabilities(rows, "id")) - each / each.sum(1, keepdims=True)).max() < 1e-4


def test_sums_do_not_depend_on_partitions_or_blocks(rows, monkeypatch):
    one = trees.Boosting(3, 3, 32, share=1.0).fit(rows.coalesce(1))
    monkeypatch.setattr(trees, "BLOCK", 64)
    many = trees.Boosting(3, 3, 32, share=1.0).fit(rows.repartition(4))
    assert all((a.feature == b.feature).all() and (a.code == b.code).all() and (a.value == b.value).all() for a, b in zip(one.trees, many.trees, strict=True))


def test_a_forest_learns_and_is_read_back_as_it_was(rows, tmp_path):
    made = trees.Forest(20, depth=6).fit(rows)
    p, y = _p(made.probabilities(rows, "id")), np.array([r[0] for r in rows.select("label", "id").orderBy("id").collect()])
    assert (p.argmax(1) == y).mean() > 0.8 and np.abs(p.sum(1) - 1).max() < 1e-9
    assert abs(made.featureImportances.toArray().sum() - 1) < 1e-9
    made.write().save(str(tmp_path / "m"))
    again = trees.TreesModel.load(str(tmp_path / "m"))
    assert (_p(again.probabilities(rows, "id")) == p).all() and again.featureImportances == made.featureImportances


def test_many_values_are_cut_at_quantiles_and_few_between_them(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(1000)], "a double, b double")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select(vector_to_array("features").alias("x"))
    few, many = trees.edges_of(rows, 2, 10)
    assert few.tolist() == [0.5, 1.5] and len(many) == 9 and np.abs(many - np.arange(100, 1000, 100)).max() <= 10
