"""From raw documents to sampled token ids, in five stages that each hand on a Parquet table.

quality classifier -> MinHash near-dedup -> secret scans -> mixing sources -> SentencePiece
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm import minhash, mixing, pieces, quality, secrets
from pitchline.llm.storage import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, doesn't reject; hosts are sources, paths their languages.

    A null or blank text has no evidence and goes by its path; null sources and languages are sites of their own;
    each of repeated rows is judged.  No documents give none.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, host=F.col("source"), path=F.col("lang")).filter("keep").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (similarity 0.8 or more on five words).

    Null and blank texts all stay; rows without an id stay only where no equal has one; of equal rows one stays.
    """
    return minhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text, a null one stays null.

    Null and blank texts stay as they are, a null source tells the scan nothing; repeated rows are masked alike.
    """
    clean = secrets.redact(docs, secrets.fit(docs), path=F.col("source"))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Blank texts weigh nothing and follow their source's threshold; null is a source of its own; rows that
    repeat an id are taken together.
    """
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless: a sampled segmentation of each document.

    Null and empty texts have no pieces; rows that repeat id and text, as the mix makes them, repeat the segmentation.
    """
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: Models and sampled segmentations aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
