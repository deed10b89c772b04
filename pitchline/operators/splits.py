"""Chronological splits over seasons.  Only the distinct seasons are ranked, never the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inner


def ranked_seasons(df: DataFrame, season: str, current: int | None = None) -> DataFrame:
    """(season, index from 0, newest from 1) of completed seasons; a season is one row here."""
    s = df.select(season).distinct().filter(F.col(season).isNotNull())
    s = s if current is None else s.filter(F.col(season) < current)
    return s.select(season, (F.row_number().over(Window.orderBy(season)) - 1).alias("season_index"), F.row_number().over(Window.orderBy(F.col(season).desc())).alias("season_newest"))


def chronological_split(df: DataFrame, season: str, current: int | None = None, n_test: int = 1, n_val: int = 1) -> DataFrame:
    """Rows of completed seasons with split: the last ``n_test`` seasons Test, those before Validation, the rest Train."""
    s = ranked_seasons(df, season, current)
    count = s.count()
    if count < n_test + n_val + 1:
        raise ValueError(f"{count} completed seasons are too few for {n_test} test, {n_val} validation and one training season")
    label = F.when(F.col("season_newest") <= n_test, "Test").when(F.col("season_newest") <= n_test + n_val, "Validation").otherwise("Train")
    (of,) = inner(df, "season")
    return df.join(F.broadcast(s.select(F.col(season).alias(of), label.alias("split"))), F.col(season) == F.col(of)).drop(of)  # a row a season


def walk_forward_folds(df: DataFrame, season: str, min_train: int = 3, current: int | None = None) -> DataFrame:
    """(fold, season, role): each season from the ``min_train``-th on is tested once, all before it train."""
    s = ranked_seasons(df, season, current)
    test = s.filter(F.col("season_index") >= min_train).select(F.col("season_index").alias("fold"))
    pairs = s.join(F.broadcast(test), F.col("season_index") <= F.col("fold"))
    return pairs.select("fold", season, F.when(F.col("season_index") == F.col("fold"), "test").otherwise("train").alias("role"))


def backtest_floor(completed: int) -> int:
    return max(3, completed - 3)


def pooled_last(df: DataFrame, season: str, most: int = 3) -> DataFrame:
    """Rows repeated for each n up to ``most`` whose last n seasons hold them, with column last_n."""
    s = ranked_seasons(df, season).filter(F.col("season_newest") <= most)
    (of,) = inner(df, "season")
    s = s.select(F.col(season).alias(of), F.explode(F.sequence(F.col("season_newest"), F.lit(most))).alias("last_n"))
    return df.join(F.broadcast(s), F.col(season) == F.col(of)).drop(of)
