"""The driver tables read as contests.

A match is an order: home is the customer's nation, away a nation derived from the order key, goals
are derived from key and price, the season is the order's year.  A team log is the event stream:
the team is the user, the metric the value, missing where the event is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    j = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = j.select(
        F.col("o_orderkey").alias("MatchID"), F.to_date("o_orderdate").alias("Date"), F.year("o_orderdate").alias("SeasonStartYear"),
        F.col("c_nationkey").cast("long").alias("HomeTeam"), ((F.col("o_orderkey") * 7 + 3) % 25).alias("AwayTeam"),
        (F.col("o_orderkey") % 5).cast("int").alias("FTHG"), (F.floor("o_totalprice") % 4).cast("int").alias("FTAG"),
        (F.floor("o_totalprice") % 20).cast("int").alias("HS"), (F.floor("o_totalprice") % 17).cast("int").alias("AS"),
    )
    rows = rows.filter("HomeTeam <> AwayTeam")
    return rows.withColumn("FTR", F.when(F.col("FTHG") > F.col("FTAG"), "H").when(F.col("FTHG") < F.col("FTAG"), "A").otherwise("D"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pseudo-probabilities: (id, source, season, y, p_h, p_d, p_a) of each match, in eighths so that ties occur."""
    m = matches(spark, sf_dir)
    a, b, c = F.col("MatchID") % 7 + 1, F.col("MatchID") % 5 + 1, F.col("MatchID") % 11 + 1
    t = (a + b + c).cast("double")
    return m.select(F.col("MatchID").alias("id"), F.concat(F.lit("m"), (F.col("MatchID") % 3).cast("string")).alias("model"), F.col("SeasonStartYear").alias("season"), F.col("FTR").alias("y"), (a / t).alias("p_h"), (b / t).alias("p_d"), (c / t).alias("p_a"), (F.col("FTHG") + F.col("FTAG")).alias("goals"))


#: The same tables as common table expressions in DuckDB SQL.
SQL_MATCHES = """
m as (
  select *, case when fthg > ftag then 'H' when fthg < ftag then 'A' else 'D' end as ftr from (
    select o_orderkey as id, o_orderdate::date as d, year(o_orderdate)::int as season, c_nationkey::bigint as home, (o_orderkey * 7 + 3) % 25 as away,
           (o_orderkey % 5)::int as fthg, (floor(o_totalprice)::bigint % 4)::int as ftag, (floor(o_totalprice)::bigint % 20)::int as hs, (floor(o_totalprice)::bigint % 17)::int as as_
    from orders join customer on o_custkey = c_custkey) where home <> away)"""
SQL_EVENTS = """
ev as (select event_id, ts, user_id, event_type, case when event_type <> 'error' then value end as value from events)"""
SQL_PROBS = (
    SQL_MATCHES
    + """,
p as (
  select id, 'm' || (id % 3)::varchar as model, season, ftr as y, (id % 7 + 1) / t as p_h, (id % 5 + 1) / t as p_d, (id % 11 + 1) / t as p_a, fthg + ftag as goals
  from (select *, (id % 7 + 1 + id % 5 + 1 + id % 11 + 1)::double as t from m))"""
)
