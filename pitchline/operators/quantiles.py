"""Exact quantiles of many columns at once, by histograms that narrow down on the ranks asked for.

Each round counts, in one aggregation over all columns, how many values fall into each of a fixed number of ranges
between the bounds that are still open; the range that holds a rank gives the next bounds, as its values' own
minimum and maximum.  No task holds a column's distinct values, and the driver sees counts whose number is bounded by
columns, ranks and ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of an open interval in each round.
RANGES = 1024
_INF = float("inf")


def _even(low: float, high: float) -> bool:
    """Whether ranges of equal width suit an interval; else they are equal in orders of magnitude."""
    return low * high > 0 and max(low / high, high / low) < RANGES


def _size(v: Column) -> Column:
    """A value's order of magnitude with its sign; the least double that isn't 0 still has a positive one."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def exact_quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...], ranges: int = RANGES) -> dict[str, list[float] | None]:
    """Each column's interpolated quantiles, nulls aside; None for a column without values.

    NaN counts as the largest value, as Spark orders it.  Columns are read as double.
    """
    if not columns:
        return {}
    names = [f"c{i}" for i in range(len(columns))]
    wide = df.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, columns, strict=True)])
    plain = lambda n: (F.col(n) > -_INF) & (F.col(n) < _INF)
    first = wide.agg(*[x for n in names for x in (F.count(n).alias(f"{n}_n"), F.count_if(F.col(n) == -_INF).alias(f"{n}_low"), F.count_if(F.col(n) == _INF).alias(f"{n}_high"), F.count_if(F.isnan(n)).alias(f"{n}_nan"), F.min(F.when(plain(n), F.col(n))).alias(f"{n}_from"), F.max(F.when(plain(n), F.col(n))).alias(f"{n}_to"))]).first()
    values: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}  # (column, rank): bounds, and the rank within them
    for n in names:
        size, low, high, nan = (first[f"{n}_{k}"] for k in ("n", "low", "high", "nan"))
        for rank in {r for q in at for r in (math.floor(q * (size - 1)), math.ceil(q * (size - 1)))} if size else ():
            if rank < low:
                values[n, rank] = -_INF
            elif rank >= size - nan:
                values[n, rank] = math.nan
            elif rank >= size - nan - high:
                values[n, rank] = _INF
            else:
                open_[n, rank] = first[f"{n}_from"], first[f"{n}_to"], rank - low
    long = wide.unpivot([], names, "column", "value").filter(plain("value"))
    while True:
        for key in [k for k, (a, b, _) in open_.items() if a == b]:
            values[key] = open_.pop(key)[0]
        if not open_:
            break
        bounds = sorted({(n, a, b) for (n, _), (a, b, _) in open_.items()})  # two ranks a quantile at most
        table = df.sparkSession.createDataFrame([(*x, _even(*x[1:])) for x in bounds], "name string, low double, high double, even boolean")
        from_low = lambda c: F.when(F.col("even"), F.col(c) - F.col("low")).otherwise(_size(F.col(c)) - _size(F.col("low")))
        share = from_low("value") / from_low("high")  # never falls with the value, so ranges are in its order
        inside = long.join(F.broadcast(table), (F.col("column") == F.col("name")) & F.col("value").between(F.col("low"), F.col("high")))
        got = inside.groupBy("name", "low", "high", F.least(F.floor(share * ranges), F.lit(ranges - 1)).alias("range")).agg(F.count("*").alias("n"), F.min("value").alias("from"), F.max("value").alias("to")).collect()
        held: dict[tuple[str, float, float], list] = {}
        for r in sorted(got, key=lambda r: r["range"]):
            held.setdefault((r["name"], r["low"], r["high"]), []).append(r)
        for (n, rank), (a, b, left) in list(open_.items()):
            for r in held[n, a, b]:
                if left < r["n"]:
                    open_[n, rank] = r["from"], r["to"], left
                    break
                left -= r["n"]
    out: dict[str, list[float] | None] = {}
    for n, c in zip(names, columns, strict=True):
        size, got_all = first[f"{n}_n"], []
        for q in at:
            place = q * (size - 1)
            if not size:
                break
            a, b = values[n, math.floor(place)], values[n, math.ceil(place)]
            got_all.append(a if a == b or math.floor(place) == math.ceil(place) else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
        out[c] = got_all if size else None
    return out
