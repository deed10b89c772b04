from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, `rep` string, _text string, h double"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "rivers", "mountain", "quiet", "seven", "table", "window", "Zeta", "naïve", "straße"]
    return " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    base = words(120, 1)
    texts = [base, base, base.replace("alpha", "ALPHA", 1), base + " tail", words(120, 2), None, "", " \t\n", "one", "one two three", words(30_000, 3), "x" * 20_000, "▁ odd ▁▁ 😀\x00 text", "123 456 !!", words(120, 1)]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "é"][i % 4], None if t is None else len(t), 7, "k", 3, "r", "clash", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[4]]  # repeated rows
    rows += [(None, base, None, None, None, None, None, None, None, None, None), (99, "other text under a used id", "en", "a", 1, 1, "k", 1, "r", "c", 0.1), (99, words(60, 9), "en", "a", 1, 1, "k", 1, "r", "c", 0.1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
