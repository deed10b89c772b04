"""Working columns that don't clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def inner(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` bears, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
