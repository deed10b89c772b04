from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from pitchline.llm import mixing


def brute_targets(sizes: dict, cap: float = 3.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
            total -= target[s]
        open_ -= full
    return target


def test_targets_and_taken_words(spark, odd_docs):
    rows = mixing.mix_report(odd_docs).collect()
    texts = odd_docs.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += count(r["text"])
    target = brute_targets(sizes)
    assert len(rows) == len(texts)
    assert sorted(r["size"] for r in rows) == sorted(count(r["text"]) for r in texts)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3 * largest[s]
    again = mixing.mix_report(odd_docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_even_sources_come_near_their_targets_and_budgets_nest(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"))
    full = mixing.mix_report(df, budget=1.0)
    for r in full.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= 40
    half = mixing.mix_report(df, budget=0.3)
    lost = half.filter("copies > 0").select("doc_id").exceptAll(full.filter("copies > 0").select("doc_id"))
    assert lost.count() == 0


def test_mix_keeps_columns_and_repeats_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    report = mixing.mix_report(odd_docs)
    assert out.count() == report.agg(F.sum("copies")).first()[0]
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix_report(no_docs).count() == 0
