"""Comparison of items that share buckets, without a row for any pair.

Only those of a bucket's pairs are compared that could still join two components:

1. every item goes to the group of one leader, the smallest member of its buckets; the group is
   compared in parts by hash, each with the leader, which joins dense groups in linear time;
2. buckets that still hold several components are joined where they overlap, dealt into parts, and
   parts meet two by two; parts of one large component don't meet one another.

A part is bounded in rows and in units of size (shingles, say); small groups share parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import apart, table

Compare = Callable[[pa.Table], pa.Table]


def within(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of x and y differ in at most ``distance`` positions."""
    out = np.empty((len(x), len(y)), bool)
    columns = np.ascontiguousarray(y.T)
    for a in range(0, len(x), 128):
        differ = np.zeros((len(x[a : a + 128]), len(y)), np.uint8)
        for k in range(x.shape[1]):
            differ += x[a : a + 128, k, None] != columns[k]
        out[a : a + 128] = differ <= distance
    return out


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the left (side 0) and on the right (1); rows of side 2 meet one another."""
    side = group.column("side").to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


@dataclass
class Size:
    """Rows and units of a part, on average (a comparison holds two parts), and rows of a part that small groups share."""

    rows: int
    units: int
    shared: int

    def parts(self, rows: Column, units: Column) -> Column:
        return rows / self.rows + units / self.units

    @property
    def small(self) -> float:
        return min(1.0, self.shared / self.rows)

    def bins(self, rows: DataFrame) -> int:
        """Into how many parts rows of n units go if small groups share them."""
        return int((rows.agg(self.parts(F.count("*"), F.sum("n"))).first()[0] or 0) / self.small) + 1


def _leader_links(members: DataFrame, items: DataFrame, payload: list[str], compare: Compare, size: Size) -> DataFrame:
    """(cid, root) found in the groups of the leaders, the smallest members of a class's buckets."""
    choice = table(members.groupBy("cid").agg(F.min("low").alias("lead")).join(items.select("cid", "n"), "cid"))
    bins = size.bins(choice)
    share = choice.groupBy("lead").agg(size.parts(F.count("*"), F.sum("n")).alias("w"))
    alone = F.col("w") >= size.small
    share = share.select("lead", F.when(alone, F.ceil("w")).otherwise(0).cast("int").alias("parts"))
    bin_ = F.when(F.col("parts") == 0, F.pmod(F.xxhash64("lead"), F.lit(bins)))
    rows = choice.filter("cid <> lead").withColumn("k", apart("lead")).join(share.select(apart("lead").alias("k"), "parts"), "k").select("cid", F.coalesce(bin_, F.xxhash64("lead", F.pmod(F.xxhash64("cid"), "parts"))).alias("m"))
    each = share.select("lead", "parts", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)).alias("k"))
    hubs = each.select(F.col("lead").alias("cid"), F.coalesce(bin_, F.xxhash64("lead", F.col("k").cast("long"))).alias("m"))
    dealt = rows.unionAll(hubs).join(items.select("cid", *payload), "cid").select("m", "cid", F.col("cid").alias("comp"), F.lit(2).alias("side"), *payload)
    return dealt.groupBy("m").applyInArrow(compare, "cid long, root long")


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (cid, comp, low) of the buckets whose members aren't all in one component."""
    for x in ("cid", "low"):
        to = comp.select(F.col("cid").alias(x), F.col("comp").alias(f"comp_{x}"))
        members = members.join(to, x, "left").withColumn(f"comp_{x}", F.coalesce(f"comp_{x}", x))
    members = members.withColumn("k", apart("key"))
    several = members.filter("comp_cid <> comp_low").select("key").distinct().select(apart("key").alias("k"))
    return members.join(several, "k", "left_semi").select("cid", F.col("comp_cid").alias("comp"), "low").distinct()


def _meeting_links(mixed: DataFrame, items: DataFrame, payload: list[str], compare: Compare, scout: Compare | None, light: list[str], size: Size) -> DataFrame:
    """(cid, root) between components: overlapping buckets are one cluster, whose parts meet two by two."""
    cluster = connected_components(mixed, "cid", "low").select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    rows = table(mixed.select("cid", "comp").distinct().join(cluster, "cid").join(items.select("cid", "n"), "cid"))
    bins = size.bins(rows)
    # a component that fills a part has parts of its own, the others of a cluster share parts (pure null); small clusters share meetings
    of = rows.groupBy("cluster", "comp").agg(size.parts(F.count("*"), F.sum("n")).alias("w")).withColumn("pure", F.when(F.col("w") >= 1, F.col("comp")))
    parts = of.groupBy("cluster", "pure").agg(F.ceil(F.sum("w")).cast("int").alias("parts"))
    hash_ = F.xxhash64("cluster", "pure", F.col("pure").isNull()).alias("hash")
    parts = parts.join(of.groupBy("cluster").agg((F.sum("w") < size.small).alias("small")), "cluster").select("*", hash_)
    rows = rows.withColumn("k", apart("cluster")).join(of.select(apart("cluster").alias("k"), "comp", hash_), ["k", "comp"])
    rows = rows.join(parts.select("hash", "parts"), "hash").select("cid", "comp", F.xxhash64("hash", F.pmod(F.xxhash64("cid"), "parts")).alias("part"))
    each = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", "small", "pure", F.xxhash64("hash", F.col("k").cast("long")).alias("part"))
    other = each.select("cluster", F.col("pure").alias("pure_b"), F.col("part").alias("part_b"))
    meet = each.join(other, "cluster").filter("part <= part_b and (pure is null or pure_b is null or pure <> pure_b)")
    meet = meet.withColumn("m", F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("part", "part_b")))
    seat = lambda part, side: F.struct(F.col(part).alias("part"), F.lit(side).alias("side"))
    seats = meet.select("m", F.explode(F.when(F.col("part") == F.col("part_b"), F.array(seat("part", 2))).otherwise(F.array(seat("part", 0), seat("part_b", 1)))).alias("s")).select("m", "s.*")
    dealt = rows.join(seats, "part").select("m", "cid", "comp", "side")
    if scout:
        seen = dealt.join(items.select("cid", *light), "cid").select("m", "cid", "comp", "side", *light)
        dealt = table(seen.groupBy("m").applyInArrow(scout, "m long, cid long, comp long, side int"))
    return dealt.join(items.select("cid", *payload), "cid").select("m", "cid", "comp", "side", *payload).groupBy("m").applyInArrow(compare, "cid long, root long")


def linked(members: DataFrame, items: DataFrame, payload: list[str], compare: Compare, scout: Compare | None = None, light: list[str] | None = None, rows: int = 2048, units: int = 1_000_000, shared: int = 512) -> DataFrame:
    """(cid, root): links that span what the items of common buckets are joined by.

    ``members``: (key, cid, low), the items of each bucket and its smallest; ``items``: (cid, n, ...), each item
    once with its size in units.  ``compare`` sees rows (m, cid, comp, side, payload) of one meeting and gives
    (cid, root) of those that a link joins to a smaller one; items of equal comp needn't be compared.  ``scout`` sees
    the ``light`` columns alone and gives the rows (m, cid, comp, side) that ``compare`` has to see.
    """
    size = Size(rows, units, shared)
    led = table(_leader_links(members, items, payload, compare, size))
    further = led.select(F.col("cid").alias("root"), F.col("root").alias("comp"))
    comp = led.join(further, "root", "left").select("cid", F.coalesce("comp", "root").alias("comp"))
    mixed = table(_mixed(members, comp))
    if mixed.isEmpty():
        return led
    return led.unionAll(_meeting_links(mixed, items, payload, compare, scout, light or [], size))
