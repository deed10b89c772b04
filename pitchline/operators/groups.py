"""Groups of sides that meet, directly or through others: what happens in one doesn't touch another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Pairs up to which groups are found on the driver; more are joined in rounds.
DRIVER_PAIRS = 100_000


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group) of every node of ``pairs`` (strings); group is the smallest node reachable.

    Repeated pairs count once; a node paired with itself is a group of its own unless others join it.
    """
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    few = pairs.limit(DRIVER_PAIRS + 1).collect()
    if len(few) > DRIVER_PAIRS:
        return _by_rounds(pairs)
    root: dict[str, str] = {}

    def top(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in few:
        low, high = sorted((top(x), top(y)))
        root[high] = low
    nodes = sorted(root)
    out = pairs.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.string()), "group": pa.array([top(x) for x in nodes], pa.string())}))  # a local relation: no job a use
    return F.broadcast(out)  # two rows a pair at most


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """Alternating stars: edges move to the smallest neighbour of their lower, then of their upper end, until all end at their group's smallest node."""
    e, seen = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()) != seen:
        seen = now
        least = e.unionAll(e.select("v", "u")).groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).filter("m < k")
        large = e.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(low.select("k", "m")).distinct())
    alone = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).unionAll(alone.select("node", F.col("node").alias("group")))
