"""From raw documents to token ids: quality rules, line dedup, n-gram Jaccard join, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's
result as Parquet below the shared checkpoint folder and reads it again for the next one, so a lost
executor costs at most the running stage.  All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentipanel.llm import line_dedup, mixing, ngram_join, quality, spm
from sentipanel.llm.common import WORD, ensure_checkpoint_dir, read
from sentipanel.llm.registry import piece_model


BATCH_ROWS = "1000"  # rows of an Arrow batch: whole texts are wide, and two workers of an executor hold a batch each, on both sides


def _narrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    _narrow_batches(spark)
    return quality.quality_rules(docs, carry_text=True).where("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose every line with a word."""
    d = line_dedup.line_dedup(docs, min_chars=1, near_chars=1)
    d = d.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, Jaccard 0.8) one document stays."""
    _narrow_batches(spark)
    return ngram_join.keep_one(docs, shingle_words=5, num=80, den=100).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs, mixing.plan_mix(docs)).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document.  A smaller table of remembered units than alone: the workers of earlier stages stay alive."""
    _narrow_batches(spark)
    return spm.encode_decode(docs, piece_model(), table_rows=100_000)


STAGES = [
    ("10 quality rules", quality_stage),
    ("7 line dedup", line_dedup_stage),
    ("6 n-gram Jaccard join", near_copies_stage),
    ("2 mixing sources", mix_stage),
    ("5 SentencePiece", token_stage),
]

# Edit distances, shingle joins and tokenisers have no SQL twin; tests hold run() against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
