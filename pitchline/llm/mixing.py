"""Operator 1: mixing sources to target weights by hash-threshold histograms.

Each document gets a fixed 60-bit hash of its id.  A source takes whole repeats of all its
documents and, for the rest of its target, the documents whose hash lies under a threshold.
The threshold comes from histograms, not from a sort: sum words by (source, 12-bit hash
bucket), find the bucket in which the running sum crosses the budget, and refine that bucket
alone with the next 12 bits, until it holds one hash.  A larger budget only raises the
threshold, so mixes for growing budgets are nested.

Histograms are combined before they are shuffled, a hot source costs no task more than its
share, and each source's window spans at most 4,096 bucket rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, inner

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
#: Rows up to which the per-source table (about 100 bytes a row) is broadcast to documents.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """The first 60 bits of the id's MD5, so that other engines can reproduce it; null counts as an id of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """(source, source_size, target): ``budget`` times all words, shared by weight, no source above ``cap`` times its size.

    Sources stand by code point, null last, and take ``weights`` in turn.  What capped sources
    leave is shared among the others by weight until none is above its cap: sources fill up in
    the order of cap/weight, so one ordered pass over the sources finds the common level.
    One row a source reaches the ordered pass; documents don't.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("fill", F.col("most") / F.col("weight"))
    upto, every = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    full = F.sum("most").over(upto) - F.col("most")
    heavy = F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - full) / heavy)
    # the first source that its level doesn't fill sets the level of all that come after
    common = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    share = F.coalesce(F.least(common * F.col("weight"), F.col("most")), F.col("most"))
    return per.select("source", "source_size", share.alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``repeats`` (whole copies of every document) and ``cut`` (one more for hashes up to it; -1: none).

    ``sizes``: (source, size, h).  Refines the boundary bucket level by level; a level reads only
    the rows of boundary buckets, about 1/4096 of the level before.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("repeats", whole).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = cut(state.withColumns({"prefix": F.lit(0).cast("long"), "cut": F.lit(-1).cast("long"), "open": F.col("rest") > 0}))
    inside = sizes.filter("size > 0")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        live = state.filter("open").select(F.col("source").alias("s"), "prefix", "rest")
        inside = inside.join(F.broadcast(live) if live.count() <= BROADCAST_SOURCES else live, F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        bucket = inside.groupBy("source", F.shiftright("h", shift).alias("bucket"), "rest").agg(F.sum("size").alias("w"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("w").over(Window.partitionBy("source").orderBy("bucket"))
        crossing = bucket.withColumn("upto", upto).filter("upto >= rest and upto - w < rest")
        found = crossing.select(
            F.col("source").alias("f"), F.col("bucket").alias("new_prefix"), (F.col("rest") - F.col("upto") + F.col("w")).alias("new_rest"),
            F.when(F.col("low") == F.col("high"), F.when((F.col("rest") - F.col("upto") + F.col("w")) * 2 >= F.col("w"), F.col("high")).otherwise(F.col("low") - 1)).alias("new_cut"),
        )
        state = state.join(found, F.col("source").eqNullSafe(F.col("f")) & F.col("open"), "left").select(
            "source", "source_size", "target", "repeats", F.coalesce("new_rest", "rest").alias("rest"), F.coalesce("new_prefix", "prefix").alias("prefix"),
            # a rest that rounding puts above all words takes them all
            F.coalesce(F.when(F.col("open"), F.when(F.col("f").isNull() & F.col("new_prefix").isNull(), F.lit(2**62)).otherwise(F.col("new_cut"))), F.col("cut")).alias("cut"),
            (F.col("open") & F.col("new_prefix").isNotNull() & F.col("new_cut").isNull()).alias("open"),
        )
        state = cut(state)
        inside = inside.drop("s", "prefix", "rest")
        if not state.filter("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "repeats", "cut")


def plan_mix(df: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], cap: float, budget: float) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow table (key, source, size, h) and the per-source plan."""
    narrow = cut(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), id_hash(F.col(key)).alias("h")))
    return narrow, thresholds(narrow, targets(narrow, weights, cap, budget))


def _with_plan(rows: DataFrame, source: Column, plan: DataFrame) -> DataFrame:
    (name,) = inner(rows, "plan_source")
    plan = plan.withColumnRenamed("source", name)
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, source.eqNullSafe(F.col(name)), "left").drop(name)


def mix_report(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """One row a document: key, source, size, source_size, target, copies and taken words.

    Null or empty text: size 0, taken 0.  A null source is a source of its own, the last.  Rows
    that repeat a key share its hash and are taken together.  Documents whose hash is the one in
    which the target falls are taken or left, whichever comes nearer.  An empty table gives none.
    """
    narrow, plan = plan_mix(df, key, source, text, weights, cap, budget)
    copies = F.col("repeats") + (F.col("h") <= F.col("cut")).cast("long")
    out = _with_plan(narrow, F.col("source"), plan).withColumn("copies", copies)
    return out.select(F.col("key").alias(key), F.col("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """The mixed corpus: each row of ``df``, with its columns, as often as the mix takes it.

    Only the narrow table is shuffled; texts stay in their partitions.  Rows whose text is null or has no words
    weigh nothing and follow their source's threshold; a null source is a source of its own; rows that repeat a key are taken or
    left together.  An empty table gives an empty result.
    """
    _, plan = plan_mix(df, key, source, text, weights, cap, budget)
    whole, cut_at, one = inner(df, "repeats", "cut", "copy")
    plan = plan.select("source", F.col("repeats").alias(whole), F.col("cut").alias(cut_at))
    copies = (F.col(whole) + (id_hash(F.col(key)) <= F.col(cut_at)).cast("long")).cast("int")
    rows = _with_plan(df, F.col(source).cast("string"), plan).withColumn(one, F.explode(F.array_repeat(F.lit(1), F.coalesce(copies, F.lit(0)))))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
