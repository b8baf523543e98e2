"""Corpus pipeline: the stages that turn ``documents`` into training data.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns the columns of ``documents``, except the last, which returns
the encoded documents. ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.decontaminate import remove_leaks
from meterline.llm.jaccard_join import keep_one
from meterline.llm.scratch import written
from meterline.llm.secret_scan import redact
from meterline.llm.sentencepiece_codec import encode
from meterline.llm.toxicity import keep_clean
from meterline.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; ``n_chars`` follows the new text."""
    out = redact(docs).drop("n_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(),
                                               F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining document. The stage before leaves the
    executors' heaps full, so a task keeps few chunks: time for memory."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), cache_bytes=16 << 20)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("sentencepiece", sentencepiece)]

#: Trained scores and hashed segmentations are no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
