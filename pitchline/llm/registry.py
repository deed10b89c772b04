"""The subpackage's queries, by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, fingerprint, html, langid, lmscore, minhash, mixing, phrases, pieces, quality, secrets, vectors
from . import sql as S


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs), path=F.col("source"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    model = langid.fit(docs, fold != 1)
    held_out = docs.select(F.col("doc_id").alias("doc_id"), "text", (fold == 1).alias("held_out"))
    return langid.predict(held_out, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    return lmscore.score(_documents(spark, sf_dir), fold == 0, fold == 1, orders=3)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6's result SQL can express: all but the mixed score."""
    return op6_lm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, host=F.col("source"), path=F.col("lang"), keep_text=False)
    return scored.select("doc_id", "evidence", "host_share", "path_share", "quality", "keep")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_with_groups(_documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_html_text, op3_sentencepiece_sampling, op4_secret_scan, op5_language_id, op6_lm_score, op7_quality, op8_embedding_near_dedup, op9_edit_fingerprint, op10_minhash_near_dedup, op11_cross_alignment, op12_phrase_collocations, op13_byte_bpe, pipeline, lm_base_scores)}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": S.SOURCE_MIX, "op8_embedding_near_dedup": S.NEAR_VECTORS, "op10_minhash_near_dedup": S.MINHASH, "op12_phrase_collocations": S.PHRASES, "lm_base_scores": S.LM_BASE}
