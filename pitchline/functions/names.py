"""Team names and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import inner

#: Spellings of team names and the canonical name of each.
ALIASES = {
    "Man Utd": "Man United", "Spurs": "Tottenham", "Manchester United": "Man United", "Manchester Utd": "Man United", "Manchester City": "Man City", "Tottenham Hotspur": "Tottenham",
    "Nottingham Forest": "Nott'm Forest", "Wolverhampton Wanderers": "Wolves", "Newcastle United": "Newcastle", "West Ham United": "West Ham", "Brighton & Hove Albion": "Brighton",
    "Leeds United": "Leeds", "Ipswich Town": "Ipswich", "Luton Town": "Luton", "Sheffield Utd": "Sheffield United", "Leicester City": "Leicester", "Norwich City": "Norwich", "Cardiff City": "Cardiff",
    "Huddersfield Town": "Huddersfield", "Stoke City": "Stoke", "Swansea City": "Swansea", "West Bromwich Albion": "West Brom", "AFC Bournemouth": "Bournemouth", "Coventry City": "Coventry", "Hull City": "Hull", "Sunderland AFC": "Sunderland",
}


def known_name(name: Column) -> Column:
    """The canonical name by the fixed list; other names trimmed."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(name)), F.trim(name))


#: Dimension rows up to which the name map is broadcast.
BROADCAST_NAMES = 100_000


def canonical_names(df: DataFrame, column: str, names: DataFrame, priority: str = "priority") -> DataFrame:
    """``column`` trimmed and replaced by its canonical name where ``names`` (alias, canonical, priority) has one.

    Of several rows for an alias the one of the lowest priority number counts.  Null stays null, unknown names stay.
    """
    canonical, known, alias = inner(df, "canonical", "known", "alias")
    best = names.groupBy(F.col("alias").alias(known)).agg(F.min_by("canonical", priority).alias(canonical))
    small = best.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    best = F.broadcast(best) if small else best
    out = df.withColumn(alias, F.trim(column)).join(best, F.col(alias) == F.col(known), "left")
    return out.select(*[F.coalesce(canonical, alias).alias(c) if c == column else F.col(c) for c in df.columns])


def unknown_names(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct names of ``column`` that ``known`` (name) lacks."""
    return df.select(F.trim(column).alias("name")).filter("name is not null").distinct().join(known.select("name"), "name", "left_anti")


def localised(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """``columns`` as ``names`` (name, shown) shows them; names it lacks stay as they are."""
    for c in columns:
        df = canonical_names(df, c, names.select(F.col("name").alias("alias"), F.col("shown").alias("canonical"), F.lit(1).alias("priority")))
    return df


def match_id(day: Column, home: Column, away: Column) -> Column:
    """yyyyMMdd_Home_Away without blanks."""
    clean = lambda c: F.replace(c.cast("string"), F.lit(" "), F.lit(""))
    return F.concat_ws("_", F.date_format(day, "yyyyMMdd"), clean(home), clean(away))
