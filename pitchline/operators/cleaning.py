"""From raw results and fixtures to clean tables and a quality report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import match_id
from ..functions.probability import result

#: Columns and their accepted ranges.
CORE = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")
FIXTURE_CORE = ("Round Number", "Date", "Home Team", "Away Team")
OPTIONAL = ("HTHG", "HTAG", "HTR", "HS", "AS", "HST", "AST", "HC", "AC", "HF", "AF", "HY", "AY", "HR", "AR", "HxG", "AxG", "Referee")
BOUNDS = {"FTHG": (0, 15), "FTAG": (0, 15), "HS": (0, 50), "AS": (0, 50), "HST": (0, 35), "AST": (0, 35), "HC": (0, 25), "AC": (0, 25), "HF": (0, 40), "AF": (0, 40), "HY": (0, 11), "AY": (0, 11), "HR": (0, 5), "AR": (0, 5), "HxG": (0, 9), "AxG": (0, 9)}


def require_columns(df: DataFrame, needed: tuple[str, ...], source: str = "input") -> DataFrame:
    """``df`` itself; a ValueError that names the columns it lacks, before any job runs."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{source} lacks columns {missing}")
    return df


def keep_existing(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def drop_incomplete(df: DataFrame, needed: tuple[str, ...] = CORE) -> DataFrame:
    return df.na.drop("any", subset=list(needed))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; deterministic, unlike dropDuplicates."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def violations(df: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, column_name, value): non-null values outside their range, as one unpivot of the checked columns."""
    have = [c for c in bounds if c in df.columns]
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in have]).unpivot([key], have, "column_name", "value")
    low, high = (F.create_map(*[x for c in have for x in (F.lit(c), F.lit(float(bounds[c][i])))]) for i in (0, 1))
    return long.filter((F.col("value") < low[F.col("column_name")]) | (F.col("value") > high[F.col("column_name")]))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, coverage): per cent of non-null values, one decimal; 0.0 for absent columns and empty tables."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns if c in df.columns])
    share = lambda c: F.when(F.col("_n") > 0, F.round(100.0 * F.col(c) / F.col("_n"), 1)).otherwise(0.0) if c in df.columns else F.lit(0.0)
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), share(c).alias("coverage")) for c in columns])).alias("x")).select("x.*")


def clean_results(raw: DataFrame, order: list[Column]) -> DataFrame:
    """Complete, unique matches with a recomputed result and a MatchID; ``order``: the rows' order in their files."""
    require_columns(raw, CORE, "results")
    rows = keep_first(drop_incomplete(raw), ["Date", "HomeTeam", "AwayTeam"], order)
    rows = rows.withColumns({"FTHG": F.col("FTHG").cast("int"), "FTAG": F.col("FTAG").cast("int")})
    rows = rows.withColumns({"FTR": result(F.col("FTHG"), F.col("FTAG")), "MatchID": match_id(F.col("Date"), F.col("HomeTeam"), F.col("AwayTeam"))})
    return keep_existing(rows, ("MatchID", "Season", "SeasonStartYear", *CORE, *OPTIONAL))


def quality_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows in and out, rows without a core value, repeated matches, results that had to be corrected."""
    complete = F.lit(True)
    for c in CORE:
        complete = complete & F.col(c).isNotNull()
    wrong = complete & (F.col("FTR") != result(F.col("FTHG").cast("int"), F.col("FTAG").cast("int")))
    a = raw.agg(F.count("*").alias("rows_in"), F.count_if(~complete).alias("missing_core"), F.count_if(wrong).alias("result_fixes"))
    return a.crossJoin(F.broadcast(clean.agg(F.count("*").alias("rows_out")))).withColumn("duplicates", F.col("rows_in") - F.col("missing_core") - F.col("rows_out"))


def fixture_calendar(fixtures: DataFrame, results: DataFrame) -> DataFrame:
    """Fixtures renamed, with Played: whether results hold a match of the same day and teams (null dates: false)."""
    fx = require_columns(fixtures, FIXTURE_CORE, "fixtures").withColumnsRenamed({"Round Number": "RoundNumber", "Home Team": "HomeTeam", "Away Team": "AwayTeam", "Location": "Venue"})
    return mark_existing(fx, results, {"day": (F.to_date("Date"), F.to_date("Date")), "h": (F.col("HomeTeam"), F.col("HomeTeam")), "a": (F.col("AwayTeam"), F.col("AwayTeam"))}, "Played")


def mark_existing(df: DataFrame, other: DataFrame, keys: dict[str, tuple[Column, Column]], name: str) -> DataFrame:
    """``df`` with a boolean: whether ``other`` has a row with equal keys; a null key never matches."""
    seen = other.select(*[b.alias(f"_k_{k}") for k, (_, b) in keys.items()]).distinct().withColumn("_seen", F.lit(True))
    left = df.withColumns({f"_l_{k}": a for k, (a, _) in keys.items()})
    on = [F.col(f"_l_{k}") == F.col(f"_k_{k}") for k in keys]
    return left.join(seen, on, "left").select(*[F.col(c) for c in df.columns], F.col("_seen").isNotNull().alias(name))


def schedule_gaps(calendar: DataFrame, as_of: date, grace_days: int = 2) -> DataFrame:
    """Fixtures that are over for more than ``grace_days`` and not played."""
    return calendar.filter(~F.col("Played") & (F.to_date("Date") < F.date_sub(F.lit(as_of), grace_days)))
