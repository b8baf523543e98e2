"""Commit-event log (S5): ``{dedupe_id, event}`` JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_EVENT_SCHEMA = "dedupe_id string, event string, _corrupt_record string"
COMMIT_EVENT = "codex.git.commit"


def valid_events(df: DataFrame) -> DataFrame:
    """Malformed lines and records without an id are tolerated and skipped,
    as the dedup reader does; any string is an id."""
    return df.where(F.col("_corrupt_record").isNull() &
                    F.col("dedupe_id").isNotNull() &
                    (F.col("event") == COMMIT_EVENT)).drop("_corrupt_record")


def read_commit_events(spark: SparkSession, path: str) -> DataFrame:
    """S5 batch: every valid record with its file and arrival (file time)."""
    df = (spark.read.schema(COMMIT_EVENT_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .select("*", F.col("_metadata.file_modification_time").alias("arrival_ts")))
    return valid_events(df)


def stream_commit_events(spark: SparkSession, path: str) -> DataFrame:
    """S5 stream: new landed files only; the checkpoint replaces the
    collector's "start at end" (already-processed files are not recounted)."""
    df = (spark.readStream.schema(COMMIT_EVENT_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .withColumn("arrival_ts", F.current_timestamp()))
    return valid_events(df)
