"""Composed jobs over the driver tables: the ledger scan, the ledger
backfill grid, the collector flow and the unified sample table.

Tables that several queries share are written once per application
(:func:`materialized`) when first asked for; all else is lazy. What is fetched
is single rows: the time of the last sample and the bounds of the landings.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import labels as P
from ..operators import series as T
from ..operators.dedup import dedup_replays
from ..session import app_id, checkpoint_dir, move
from ..sources import ledger as L
from . import adapters

LEDGER_ENV = "env-0"          # the ledger exporter's configured env label
# Backfill cutoff for the registered history queries (exclusive,
# hour-aligned, UTC) and the categories derived from ledger cumulatives.
BACKFILL_END = "2024-01-30T00:00:00"
CATEGORIES = ["input", "cacheRead", "cacheCreation", "output", "reasoning_output"]
SAMPLE_LABELS = ["env", *P.LABELS, "le"]


def end_seconds(end: str = BACKFILL_END) -> int:
    return int(P.parse_cutoff(end).timestamp())


# ---- materialized intermediates -------------------------------------------

_MATERIALIZED: dict[tuple, str] = {}
_LOCK = threading.RLock()


def materialized(spark: SparkSession, sf_dir: str, name: str, build,
                 partition_by: list[str] | None = None, file_rows: int = 0) -> DataFrame:
    """A derived table written once per application as Parquet under the
    shared ``spark.checkpoint.dir`` and read back (like the reference's
    recording rules, which materialise shared series). Reading it back cuts
    the lineage, prunes columns and, with ``partition_by``, partitions.
    ``file_rows`` bounds a file's rows, so that its readers share the work
    evenly however many rows a writing task had."""
    key = (app_id(spark), os.path.abspath(sf_dir), name)
    with _LOCK:      # concurrent callers build a table once
        path = _MATERIALIZED.get(key)
        if path is None:
            tag = hashlib.sha1(repr(key).encode()).hexdigest()[:12]
            path = f"{checkpoint_dir(spark).rstrip('/')}/meterline/{name}-{tag}"
            writer = build().write.mode("overwrite").option("maxRecordsPerFile", file_rows)
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed ledger files: JSONL lines derived from ``events``."""
    return materialized(spark, sf_dir, "ledger_lines", lambda: adapters.ledger_lines(spark, sf_dir))


def points_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed OTLP payloads, flattened: one row per data point."""
    return materialized(spark, sf_dir, "otlp_points", lambda: adapters.otlp_points(spark, sf_dir), file_rows=FILE_ROWS)


def stream_totals_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 (plain form) as a Structured Streaming job: the landed OTLP points
    are read with ``readStream`` (a few files per micro-batch), turned into
    delta rows and summed per stream in the state store; each micro-batch
    rewrites the complete totals into a Parquet table under the checkpoint
    folder. Runs once per application (``availableNow``)."""
    from ..streaming.collector import STREAM_KEYS, cumulative_stream_plain, point_delta_rows

    def build():
        points = points_table(spark, sf_dir)
        src = points.inputFiles()[0].rsplit("/", 1)[0]
        key = hashlib.sha1(repr((app_id(spark), os.path.abspath(sf_dir))).encode()).hexdigest()[:12]
        base = f"{checkpoint_dir(spark).rstrip('/')}/meterline/stream-{key}"
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(src)
        rows = point_delta_rows(stream, arrival=adapters.arrival_minute(F.col("time_ns")))
        totals = cumulative_stream_plain(rows)

        def sink(df, batch_id):
            df.write.mode("overwrite").parquet(f"{base}/totals")

        q = (totals.writeStream.outputMode("complete").foreachBatch(sink)
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        return spark.read.parquet(f"{base}/totals").select(*STREAM_KEYS, "value")

    return materialized(spark, sf_dir, "stream_totals", build)


#: Landings of the stream with stale restart, in the order of arrival.
DROPS = 3
#: Most points of a landed file (some MB). A task's whole output in one file of
#: one row group would be read again by one task.
FILE_ROWS = 100_000


def restart_stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with staleness as a Structured Streaming job. The points land in
    ``DROPS`` slices of their arrival times, one after the other; after each
    landing the stream runs to the end of what has landed and stops, and goes
    on from its checkpoint (state in RocksDB) after the next. The slices are
    written beside the landing folder in one pass over the points; a slice lands
    as a whole, by a rename. Each micro-batch lands under its batch id. Runs
    once per application."""
    from ..streaming.collector import STREAM_KEYS, idempotent_sink, point_delta_rows
    from ..streaming.totals import restarting_totals, rocksdb_state

    def build():
        points = points_table(spark, sf_dir)
        arrival = adapters.arrival_minute(F.col("time_ns"))
        first, last = points.agg(F.min(arrival), F.max(arrival)).first()
        key = hashlib.sha1(repr((app_id(spark), os.path.abspath(sf_dir))).encode()).hexdigest()[:12]
        base = f"{checkpoint_dir(spark).rstrip('/')}/meterline/restart-{key}"
        if first is not None:
            slot = F.floor((arrival - first) * DROPS / (last - first + 60))
            points.where(arrival.isNotNull()).withColumn("slot", slot).write.option("maxRecordsPerFile", FILE_ROWS) \
                .partitionBy("slot").parquet(f"{base}/staged")
        for i in range(DROPS if first is not None else 0):
            move(spark, f"{base}/staged/slot={i}", f"{base}/land/drop-{i}")
            stream = spark.readStream.schema(points.schema).option("recursiveFileLookup", True).parquet(f"{base}/land")
            totals = restarting_totals(point_delta_rows(stream, arrival=arrival))
            with rocksdb_state(spark):
                q = (totals.writeStream.outputMode("append").foreachBatch(idempotent_sink(f"{base}/totals"))
                     .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
                q.awaitTermination()
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
        schema = ", ".join(f"{k} string" for k in STREAM_KEYS) + ", t bigint, value double"
        if first is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{base}/totals").select(*STREAM_KEYS, "t", "value")

    return materialized(spark, sf_dir, "restart_stream", build)


def tailed_events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 as a stream: the commit log lands in two parts; after each, the tail
    source reads what its files have gained since the last run. Lines land
    under their batch id and are parsed as commit events."""
    from ..sources.tail import commit_events_of, tail_lines
    from ..streaming.collector import idempotent_sink

    def build():
        lines = adapters.commit_log_lines(spark, sf_dir)
        middle = lines.agg(F.percentile_approx("us", 0.5)).first()[0]
        key = hashlib.sha1(repr((app_id(spark), os.path.abspath(sf_dir))).encode()).hexdigest()[:12]
        base = f"{checkpoint_dir(spark).rstrip('/')}/meterline/tail-{key}"
        schema = "path string, offset bigint, line string"
        if middle is None:
            return commit_events_of(spark.createDataFrame([], schema))
        for part in (F.col("us") <= middle, F.col("us") > middle):
            lines.where(part).select("line").write.mode("append").text(f"{base}/log")
            q = (tail_lines(spark, f"{base}/log", glob="*.txt").writeStream.foreachBatch(idempotent_sink(f"{base}/lines"))
                 .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
            q.awaitTermination()
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
        return commit_events_of(spark.read.schema(schema).parquet(f"{base}/lines"))

    return materialized(spark, sf_dir, "tailed_events", build)


def records_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed ledger records (S2 + S3), materialized."""
    return materialized(spark, sf_dir, "ledger_records", lambda: ledger_records(spark, sf_dir))


def kept_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay-deduplicated records (D1), materialized."""
    return materialized(spark, sf_dir, "ledger_kept",
                        lambda: dedup_replays(records_table(spark, sf_dir)))


def samples_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter series, materialized and partitioned by series name."""
    return materialized(spark, sf_dir, "samples", lambda: all_samples(spark, sf_dir),
                        partition_by=["name"])


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill categories on the hourly grid, materialized."""
    return materialized(spark, sf_dir, "history", lambda: history_categories(spark, sf_dir))


def live_categories_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live ledger's categories on the hourly grid, to the end of the
    data, materialized."""
    return materialized(spark, sf_dir, "live_categories", lambda: history_categories(spark, sf_dir, None))


def last_sample(spark: SparkSession, sf_dir: str) -> int:
    """Evaluation time of instant views: the time of the last sample of any
    lane, kept as a table of one row. It comes from the lanes' inputs, so it
    builds no series."""
    def build():
        points = admitted_points(points_table(spark, sf_dir))
        ends = [points.select(batch_of(points).alias("t")),
                adapters.commit_log(spark, sf_dir).select(adapters.arrival_minute(F.col("time_ns")).alias("t")),
                ledger_hourly(spark, sf_dir, None).select("t")]
        last = [e.agg(F.max("t").alias("t")) for e in ends]
        return last[0].unionByName(last[1]).unionByName(last[2]).agg(F.max("t").alias("t"))

    return materialized(spark, sf_dir, "last_sample", build).first()[0] or 0


def family(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """The samples of one OTLP metric: from the sample table if this
    application has it, else of this metric's points alone (streams of other
    metrics do not touch them)."""
    series = dict(P.SERIES_NAMES)[metric]
    if (app_id(spark), os.path.abspath(sf_dir), "samples") in _MATERIALIZED:
        return named(samples_table(spark, sf_dir), series)
    return materialized(spark, sf_dir, f"samples-{metric}", lambda: otlp_samples(
        points_table(spark, sf_dir).where(F.col("metric") == metric)))


# ---- ledger ---------------------------------------------------------------

def ledger_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S3 over the landed ledger lines: parsed once, then the model is
    carried over the parsed rows."""
    parsed = materialized(spark, sf_dir, "ledger_parsed", lambda: L.parse_lines(L.discover(lines_table(spark, sf_dir))))
    return L.carry_model(parsed)


def ledger_hourly(spark: SparkSession, sf_dir: str, end: str | None = BACKFILL_END) -> DataFrame:
    cutoff = F.lit(P.parse_cutoff(end).replace(tzinfo=None)) if end else None
    return A.hourly_usage(kept_table(spark, sf_dir), cutoff)


def ledger_grid(spark: SparkSession, sf_dir: str, end: str | None = BACKFILL_END) -> DataFrame:
    """T9 raw grid: cumulative per (hour, model, ledger token_type), up to
    the backfill cutoff or, without one, to the last active hour."""
    return T.hourly_grid(ledger_hourly(spark, sf_dir, end), end_seconds(end) if end else None, L.TOKEN_TYPES)


def derive_categories(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint categories from ledger cumulatives (same rule as M1, on a
    grid where every field is present): fresh input, cacheRead,
    cacheCreation, non-reasoning output, reasoning output."""
    c = {t: F.coalesce(F.col(t), F.lit(0)) for t in L.TOKEN_TYPES}
    return wide.select(
        *keys,
        F.greatest(c["input"] - c["cached_input"] - c["cache_write_input"], F.lit(0)).alias("input"),
        c["cached_input"].alias("cacheRead"),
        c["cache_write_input"].alias("cacheCreation"),
        F.greatest(c["output"] - c["reasoning_output"], F.lit(0)).alias("output"),
        c["reasoning_output"].alias("reasoning_output"),
    ).unpivot(keys, CATEGORIES, "type", "value")


def history_categories(spark: SparkSession, sf_dir: str, end: str | None = BACKFILL_END) -> DataFrame:
    """Backfill history: derived categories on the hourly grid."""
    grid = ledger_grid(spark, sf_dir, end)
    wide = grid.groupBy("t", "model").pivot("token_type", L.TOKEN_TYPES).agg(F.first("value"))
    return derive_categories(wide, ["t", "model"]).withColumn("value", F.col("value").cast("bigint"))


# ---- collector --------------------------------------------------------------

def admitted_points(points: DataFrame) -> DataFrame:
    """P2 privacy -> P3 contract -> P4 scope, in the collector's order."""
    return P.normalize_scope(P.contract_filter(P.keep_labels(points)))


def batch_of(points: DataFrame):
    return adapters.arrival_minute(F.col("time_ns"))


def sum_deltas(points: DataFrame) -> DataFrame:
    p = admitted_points(points)
    return A.compact_deltas(p, batch_of(p))


def hist_deltas(points: DataFrame) -> DataFrame:
    p = admitted_points(points)
    return A.merge_histograms(p, batch_of(p))


def otlp_delta_rows(points: DataFrame) -> DataFrame:
    """Compacted deltas as rows (metric, part, env, labels, le, t, value).

    Each admitted point becomes its rows first — a sum point one row, a
    histogram point its _sum, _count and cumulative-``le`` bucket rows (A5
    per point; cumulative over ``le`` commutes with the sum over producers)
    — and one compaction aggregate (A3/A4) then sums concurrent producers
    per batch and stream: a single shuffle, combined map-side.
    """
    from ..streaming.collector import point_delta_rows
    rows = point_delta_rows(points, arrival=batch_of(points))
    keys = ["metric", "part", "env", *P.LABELS, "le"]
    return rows.groupBy(*keys, F.col("arrival").alias("t")).agg(F.sum("value").alias("value"))


def otlp_samples(points: DataFrame) -> DataFrame:
    """A3/A4/A5 -> T1 -> P5: cumulative series as the exporter shows them."""
    keys = ["metric", "part", "env", *P.LABELS, "le"]
    return as_samples(T.delta_to_cumulative(otlp_delta_rows(points), keys=keys))


def as_samples(cum: DataFrame) -> DataFrame:
    """P5 on cumulative streams (metric, part, ...): named series."""
    named = P.series_name(cum)
    name = F.when(F.col("part") == "", F.col("name")).otherwise(
        F.concat(F.col("name"), F.lit("_"), F.col("part")))
    return named.select(name.alias("name"), *SAMPLE_LABELS, "t", "value")


def commit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit log -> P6 strip -> A10 count -> T1 -> P5."""
    log = adapters.commit_log(spark, sf_dir).withColumn("arrival_ts", F.col("time_ns"))
    stripped = P.strip_log_content(log)
    counted = A.count_events(stripped, adapters.arrival_minute(F.col("arrival_ts")))
    deltas = counted.select("metric", "env", F.col("batch_t").alias("t"), "value")
    cum = T.delta_to_cumulative(deltas, keys=["metric", "env"])
    named = P.series_name(cum)
    return named.select("name", "env", *[F.lit("").alias(c) for c in P.LABELS],
                        F.lit("").alias("le"), "t", "value")


def ledger_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live ledger counter at each hour, to the end of the data."""
    grid = ledger_grid(spark, sf_dir, None)
    lab = {c: F.lit("") for c in P.LABELS}
    lab["model"] = F.col("model")
    lab["token_type"] = F.col("token_type")
    return grid.select(F.lit("codex_ledger_token_usage_total").alias("name"),
                       F.lit(LEDGER_ENV).alias("env"),
                       *[lab[c].alias(c) for c in P.LABELS], F.lit("").alias("le"),
                       "t", F.col("value").cast("double").alias("value"))


def all_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter series: OTLP lane, commit lane and ledger lane."""
    pts = points_table(spark, sf_dir)
    return otlp_samples(pts).unionByName(commit_samples(spark, sf_dir)) \
        .unionByName(ledger_samples(spark, sf_dir))


def named(samples: DataFrame, name: str) -> DataFrame:
    return samples.where(F.col("name") == name)
