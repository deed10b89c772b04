"""Connected components by alternating large-star and small-star steps.

All state is tables in the shared folder: nothing but one number a round reaches the driver, a
lost executor costs part of a round, and a round's table goes once the next round stands.  Minima
are combined before they are shuffled, and no join relies on a grouping's shuffle, so that Spark
can split the rows of a node that very many edges share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Tables, apart


def lower_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels (indices) of linked rows to the smallest one connected."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (further := label[label] < label).any():
            label[further] = label[label[further]]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    now = Tables(edges.sparkSession)
    e = now.table(edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while _loose(e):
        last, now = now, Tables(edges.sparkSession)
        least = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
        large = e.withColumn("k", apart("v")).join(least.select(apart("u").alias("k"), "m"), "k", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        several = low.filter("m < most").select(apart("u").alias("k"), "m")
        small = large.withColumn("k", apart("u")).join(several, "k").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = now.table(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        last.drop()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _loose(e: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or smaller and larger ones: the edges aren't stars around smallest nodes yet."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s")).select("s.*")
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1")
    return bool(bad.agg(F.count("*")).first()[0])


def smallest_ids(classes: DataFrame) -> DataFrame:
    """(cid, component_id) from (cid, id, component): the smallest id of each component, for each of its classes."""
    first = classes.groupBy("component").agg(F.min("id").alias("component_id")).select(apart("component").alias("k"), "component_id")
    return classes.select("cid", apart("component").alias("k")).join(first, "k").select("cid", "component_id")
