from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchline.llm import mixing, registry

from .test_minhash import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on the rows before it, held against a plain version of its decision."""
    planted = F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit(" so password=b7db7aa4a5fcc78305 too"))).otherwise(F.col("text"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("text", planted).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, DATA).cache()
    kept = {r["doc_id"] for r in good.collect()}
    known = [d for d in labels if docs.filter(F.col("doc_id") == d).count()]
    assert sum((d in kept) == (labels[d] == 1) for d in known) / len(known) > 0.95
    single = corpus_pipeline.near_dedup_stage(spark, good, DATA).cache()
    want = brute([(r["doc_id"], r["text"]) for r in good.collect()], 80)
    assert {r["doc_id"] for r in single.collect()} == set(want.values())
    masked = corpus_pipeline.secrets_stage(spark, single, DATA).cache()
    assert masked.count() == single.count() and masked.filter("n_chars <> length(text)").count() == 0
    assert masked.filter(F.col("text").rlike(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}")).count() == 0
    assert single.filter(F.col("text").rlike(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}")).count() > 0
    mixed = corpus_pipeline.mixing_stage(spark, masked, DATA).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(masked).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies
    ids = corpus_pipeline.pieces_stage(spark, mixed, DATA)
    assert ids.count() == mixed.count() and ids.filter("not lossless").count() == 0
    for s in (good, single, masked, mixed):
        assert s.columns == docs.columns


def test_stage_list_and_empty_table(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, odd_docs):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names: defined results, no crash."""
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if "mixing" not in name:
            assert out.count() <= docs.count()
        assert out.count() > 0
        docs = out
    ids = corpus_pipeline.pieces_stage(spark, docs, DATA)
    assert ids.count() == docs.count() and ids.filter("not lossless").count() == 0


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


