"""Intermediate tables and connected components for the operators here."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


BATCH_BYTES = 4 << 20   # of texts sent to a task at a time


def small_batches(docs: DataFrame) -> None:
    """Whole texts go to the tasks in Arrow batches of bounded bytes, which
    the executor's heap and the worker hold a copy of each. It is a setting of
    the session, read when the result is computed, and stays."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read
    again: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/meterline-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable over ``links``, for every
    node that has one.

    Alternating large-star and small-star rounds: a logarithmic number of
    them in practice, each a pre-aggregated minimum per node and a join, so
    a node with very many links is an ordinary skewed join. They end when the
    edges are stars around their smallest nodes: each node has one smaller
    neighbour or is one, never both.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n_low"), F.lit(0).alias("n_high")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("n_low"), F.lit(1).alias("n_high")))))
    per = ends.groupBy("node").agg(F.sum("n_low").alias("n_low"), F.max("n_high").alias("n_high"))
    return per.filter("n_low + n_high > 1 and n_low > 0").isEmpty()
