"""Aggregations A1-A11. All are ``groupBy`` aggregates, so Spark combines
partially on the map side before the shuffle; a hot group costs one
partial row per input partition, not one task holding all its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, utc_parse
from ..sources.ledger import TOKEN_TYPES
from .labels import LABELS


def _unpivot_tokens(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Wide token columns -> (keep..., token_type, value) with value > 0."""
    stacked = df.unpivot(list(keep), TOKEN_TYPES, "token_type", "value")
    return stacked.where(F.col("value") > 0)


def ledger_totals(kept: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """A1: total per (model, token_type) over deduplicated records; only
    positive values contribute, so an all-zero type has no row."""
    return (_unpivot_tokens(kept, by)
            .groupBy(*by, "token_type")
            .agg(F.sum("value").cast("bigint").alias("value")))


def turn_records(kept: DataFrame) -> DataFrame:
    """A2: count of kept records per model."""
    return kept.groupBy("model").agg(F.count("*").cast("bigint").alias("records"))


def with_parsed_ts(kept: DataFrame) -> DataFrame:
    """Parse the raw ledger timestamp (F4); NULL marks a parse error."""
    return kept.withColumn("ts", utc_parse(F.col("ts_raw")))


def hourly_usage(kept: DataFrame, end_ts: Column | None = None) -> DataFrame:
    """Sum per (hour floor UTC, model, token_type) of records before the
    exclusive cutoff ``end_ts`` (all without one); unparsable timestamps are dropped here and
    counted by :func:`hourly_parse_errors`."""
    parsed = with_parsed_ts(kept).where(F.col("ts").isNotNull())
    if end_ts is not None:
        parsed = parsed.where(F.col("ts") < end_ts)
    hourly = parsed.withColumn("t", F.floor(epoch_seconds(F.col("ts")) / 3600).cast("bigint") * 3600)
    return (_unpivot_tokens(hourly, ["t", "model"])
            .groupBy("t", "model", "token_type")
            .agg(F.sum("value").cast("bigint").alias("value")))


def hourly_parse_errors(kept: DataFrame) -> DataFrame:
    return with_parsed_ts(kept).agg(
        F.sum(F.col("ts").isNull().cast("bigint")).alias("parse_errors"))


def history_summary(hourly: DataFrame, raw_grid: DataFrame, end: int) -> DataFrame:
    """Emitted samples (five categories per model-hour), active hours,
    models, first and last active hour, and the final cumulative
    input+output over all models (the grid row at ``end - 1h``).
    One aggregate over the union of both inputs; no join."""
    h = hourly.select("t", "model", F.lit(None).cast("string").alias("token_type"),
                      F.lit(None).cast("bigint").alias("value"), F.lit(True).alias("_h"))
    g = raw_grid.select("t", "model", "token_type", "value", F.lit(False).alias("_h"))
    u = h.unionByName(g)
    is_h = F.col("_h")
    return u.agg(
        F.sum(F.when(~is_h & (F.col("token_type") == "input"), F.lit(5)).otherwise(F.lit(0)))
        .cast("bigint").alias("samples"),
        F.count_distinct(F.when(is_h, F.col("t"))).cast("bigint").alias("hours"),
        F.count_distinct(F.when(is_h, F.col("model"))).cast("bigint").alias("models"),
        F.min(F.when(is_h, F.col("t"))).alias("first_hour"),
        F.max(F.when(is_h, F.col("t"))).alias("last_hour"),
        F.sum(F.when(~is_h & (F.col("t") == end - 3600) &
                     F.col("token_type").isin("input", "output"), F.col("value"))
              .otherwise(F.lit(0))).cast("bigint").alias("final_input_output"))


def compact_deltas(points: DataFrame, batch: Column) -> DataFrame:
    """A3: one delta per (batch, metric, env, labels) summing concurrent
    producers; producer timestamps are ignored."""
    keys = ["metric", "env", *LABELS]
    return (points.where(F.col("kind") == "sum")
            .withColumn("batch_t", batch)
            .groupBy("batch_t", *keys)
            .agg(F.sum("value").alias("value")))


def merge_histograms(points: DataFrame, batch: Column) -> DataFrame:
    """A4: histogram deltas summed per (batch, metric, env, labels, bounds):
    count, sum and bucket counts element-wise. Count and sum travel as
    position 0 before the buckets, so one scan sums them all."""
    by = ["batch_t", "metric", "env", *LABELS, "bounds"]
    h = points.where(F.col("kind") == "histogram").withColumn("batch_t", batch)
    totals = F.array(F.struct(F.col("h_count").cast("bigint").alias("n"), F.col("h_sum").cast("double").alias("s")))
    slots = F.coalesce(F.transform("bucket_counts", lambda n: F.struct(n.cast("bigint").alias("n"), F.lit(0.0).alias("s"))),
                       F.array().cast("array<struct<n:bigint,s:double>>"))
    summed = (h.select(*by, F.posexplode(F.concat(totals, slots)).alias("pos", "slot"))
              .groupBy(*by, "pos").agg(F.sum("slot.n").alias("n"), F.sum("slot.s").alias("s")))
    # Re-assemble the array in position order; its length is bounded by the
    # number of bounds, not by data volume.
    arr = summed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "s"))).alias("_all"))
    return arr.select(*by, F.col("_all")[0]["n"].alias("h_count"), F.col("_all")[0]["s"].alias("h_sum"),
                      F.transform(F.slice("_all", 2, F.size("_all")), lambda x: x["n"]).alias("bucket_counts"))


def _le_text(b: Column) -> Column:
    """Bucket bound as exposition text: integral bounds print without a
    fraction ("10", not "10.0")."""
    return F.when(b == F.floor(b), F.floor(b).cast("bigint").cast("string")).otherwise(b.cast("string"))


def bucket_series(hist: DataFrame, count_col: str = "bucket_counts",
                  keep: Sequence[str] = ()) -> DataFrame:
    """A5: per-bucket counts -> cumulative ``le`` series; the last bucket is
    ``+Inf``. The cumulative runs within one histogram row (a bounded
    array), via ``aggregate`` over a ``sequence`` — no shuffle."""
    return hist.select(*keep, F.inline(bucket_pairs(count_col)))


def bucket_pairs(count_col: str = "bucket_counts") -> Column:
    """Array of (le, count) of a histogram row, empty without buckets."""
    n = F.size(count_col)
    cum = F.transform(F.sequence(F.lit(0), n - 1),
                      lambda i: F.aggregate(F.slice(count_col, 1, i + 1), F.lit(0).cast("bigint"),
                                            lambda acc, x: acc + x))
    les = F.transform(F.sequence(F.lit(0), n - 1),
                      lambda i: F.when(i < F.size("bounds"), _le_text(F.element_at("bounds", i + 1)))
                      .otherwise(F.lit("+Inf")))
    pairs = F.zip_with(les, cum, lambda le, c: F.struct(le.alias("le"), c.alias("count")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<le:string,count:bigint>>"))


def sum_without(df: DataFrame, drop: Sequence[str], value: str = "value",
                labels: Sequence[str] | None = None) -> DataFrame:
    """A6 ``sum without(drop)``: sum over every label except ``drop``."""
    labels = [c for c in (labels or [c for c in df.columns if c != value]) if c not in drop]
    return df.groupBy(*labels).agg(F.sum(value).alias(value))


def sum_by(df: DataFrame, keep: Sequence[str], value: str = "value") -> DataFrame:
    """A7 ``sum by(keep)``; ``keep=()`` is the global sum, which over no
    rows yields no row (not 0), as in PromQL."""
    g = df.groupBy(*keep).agg(F.sum(value).alias(value), F.count("*").alias("_n"))
    return g.where(F.col("_n") > 0).drop("_n")


def count_by(df: DataFrame, keep: Sequence[str], out: str = "value") -> DataFrame:
    """A8 ``count by(keep)``: number of series per group."""
    g = df.groupBy(*keep).agg(F.count("*").cast("double").alias(out))
    return g


def count_events(events: DataFrame, batch: Column, env_col: str = "env") -> DataFrame:
    """A10: each log record is a delta of 1 to ``codex.git.commit.count``."""
    return (events.withColumn("batch_t", batch)
            .groupBy("batch_t", env_col)
            .agg(F.count("*").cast("double").alias("value"))
            .withColumn("metric", F.lit("codex.git.commit.count")))
