"""Evaluation of three-way probabilities as aggregates.  Columns: p_h, p_d, p_a and the outcome y (H, D or A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import OUTCOMES, argmax_label, normalised
from .quantiles import exact_quantiles

P = ("p_h", "p_d", "p_a")
BINS = 10
#: Range cells of the AUC's running counts: a window spans one cell's distinct scores.
AUC_CELLS = 4096
_EDGES = [i / BINS for i in range(1, BINS)]


def outcome_index(y: Column) -> Column:
    """H, D, A as 0, 1, 2; anything else null."""
    return F.when(y == "H", 0).when(y == "D", 1).when(y == "A", 2)


def predicted() -> Column:
    return argmax_label(*[F.col(p) for p in P])


def accuracy() -> Column:
    return F.avg((predicted() == F.col("y")).cast("double"))


def recall(k: str) -> Column:
    """Share of the outcome's rows that are predicted as it; null without such rows."""
    return F.avg(F.when(F.col("y") == k, (predicted() == k).cast("double")))


def row_log_loss() -> Column:
    n = normalised([F.col(p) for p in P], 1e-15, 1 - 1e-15)
    return -F.log(F.when(F.col("y") == "H", n[0]).when(F.col("y") == "D", n[1]).when(F.col("y") == "A", n[2]))


def row_brier() -> Column:
    return sum((F.pow(F.col(p) - (F.col("y") == k).cast("double"), 2.0) for p, k in zip(P, OUTCOMES, strict=True)), F.lit(0.0))


def probability_bin(p: Column) -> Column:
    """0 to 9; bins are closed below, 1.0 falls into the last.  Compared with the literal edges, not computed."""
    return sum(((p >= e).cast("int") for e in _EDGES), F.lit(0))


def calibration_bins(df: DataFrame, p: str = "p_h", hit: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, bin, predicted_mean, actual_mean, n) of each non-empty bin."""
    hit = F.col("y") == "H" if hit is None else hit
    return df.groupBy(*(by or []), probability_bin(F.col(p)).alias("bin")).agg(F.avg(p).alias("predicted_mean"), F.avg(hit.cast("double")).alias("actual_mean"), F.count("*").alias("n"))


def expected_calibration_error(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    gap = F.abs(F.col("predicted_mean") - F.col("actual_mean")) * F.col("n")
    return bins.groupBy(*(by or [])).agg((F.sum(gap) / F.sum("n")).alias("ece_home"))


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, auc): exact area by average ranks, null if a class is empty.

    Equal scores are one row from the start.  Ranks come from running counts over cells of the score and
    within each cell, so no task sees all distinct scores.
    """
    by = by or []
    s = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    s = s.withColumn("cell", F.least(F.greatest(F.floor(F.col("s") * AUC_CELLS), F.lit(0)), F.lit(AUC_CELLS)).cast("int"))
    cells = s.groupBy(*by, "cell").agg(F.sum("neg").alias("cn"))
    cells = cells.withColumn("below", F.sum("cn").over(Window.partitionBy(*by).orderBy("cell")) - F.col("cn")).drop("cn")
    inner = Window.partitionBy(*by, "cell").orderBy("s")
    ranked = s.join(cells, [*by, "cell"]).withColumn("less", F.col("below") + F.sum("neg").over(inner) - F.col("neg"))
    pairs = F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def macro_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auc): mean one-versus-rest area of the three outcomes; null if one of them is undefined."""
    by = by or []
    pair = F.array(*[F.struct(F.lit(k).alias("k"), F.col(p).alias("s"), (F.col("y") == k).alias("hit")) for p, k in zip(P, OUTCOMES, strict=True)])
    long = df.select(*by, F.explode(pair).alias("x")).select(*by, "x.*")
    each = auc(long, "s", F.col("hit"), [*by, "k"])
    return each.groupBy(*by).agg(F.when((F.count("auc") == 3), F.avg("auc")).alias("auc"))


def full_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (a group): n, accuracy, log_loss, brier, recalls, ece_home, auc."""
    by = by or []
    base = df.groupBy(*by).agg(F.count("*").alias("n"), accuracy().alias("accuracy"), F.avg(row_log_loss()).alias("log_loss"), F.avg(row_brier()).alias("brier"), *[recall(k).alias(f"recall_{k.lower()}") for k in OUTCOMES])
    ece = expected_calibration_error(calibration_bins(df, by=by), by)
    area = macro_auc(df, by)
    if by:
        return base.join(ece, by, "left").join(area, by, "left")
    return base.crossJoin(F.broadcast(ece)).crossJoin(F.broadcast(area))  # one row each


def frequency_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with p_h, p_d, p_a set to the outcome shares of ``train``, a single row."""
    share = train.agg(*[F.avg((F.col("y") == k).cast("double")).alias(p) for p, k in zip(P, OUTCOMES, strict=True)])
    return test.drop(*P).crossJoin(F.broadcast(share))


def comparison(reports: DataFrame, model: str = "model") -> DataFrame:
    """Reports rounded and by log loss, the best first."""
    return reports.select(model, "n", F.round("accuracy", 4).alias("accuracy"), F.round("log_loss", 4).alias("log_loss"), F.round("brier", 4).alias("brier"), F.round("auc", 4).alias("auc"), F.round("ece_home", 4).alias("ece_home"), *[F.round(f"recall_{k.lower()}", 3).alias(f"recall_{k.lower()}") for k in OUTCOMES]).orderBy("log_loss", model)


def beating_baseline(reports: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Models whose log loss is below the baseline's, and whether they hardly ever predict a draw."""
    base = reports.filter(F.col(model) == baseline).agg(F.min("log_loss").alias("_base"))
    return reports.filter(F.col(model) != baseline).crossJoin(F.broadcast(base)).filter("log_loss < _base").select(model, "log_loss", (F.coalesce("recall_d", F.lit(0.0)) < 0.05).alias("hardly_any_draw"))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """(column_name, q): exact interpolated quantiles of each column, nulls aside; null for a column without values."""
    return df.sparkSession.createDataFrame(list(exact_quantiles(df, columns, at).items()), "column_name string, q array<double>")


def goals_sanity(df: DataFrame) -> DataFrame:
    """Argmax accuracy, over/under 2.5 accuracy (p_over, goals) and the mean home probability by outcome."""
    over = ((F.col("p_over") > 0.5) == (F.col("goals") > 2.5)).cast("double")
    return df.agg(accuracy().alias("accuracy"), F.avg(over).alias("over_under_accuracy"), *[F.avg(F.when(F.col("y") == k, F.col("p_h"))).alias(f"mean_p_h_{k.lower()}") for k in OUTCOMES])
