"""Structured Streaming form of the collector (A3 within micro-batches, T2,
S5 streaming).

Landed OTLP JSON files are read with ``readStream``; each micro-batch is
compacted per stream and folded into keyed state that holds the running
total and the last arrival, so a stream idle past ``max_stale`` restarts
from its next delta. State lives in the checkpoint (RocksDB when
configured), so unlike the reference's in-memory processor a restart keeps
the totals. The sink writes each micro-batch under its batch id with
overwrite, so a replayed batch replaces itself instead of double counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregate as A
from ..operators import labels as P
from ..sources.commit_events import stream_commit_events
from ..sources.otlp import OTLP_SCHEMA, flatten_otlp

STREAM_KEYS = ["metric", "part", "env", *P.LABELS, "le"]


def read_otlp_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(OTLP_SCHEMA).option("multiLine", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return flatten_otlp(reader.json(path))


def point_delta_rows(points: DataFrame, arrival: F.Column | None = None) -> DataFrame:
    """Row-level (streaming-safe) deltas: privacy, contract and scope first,
    then one row per sum point and per histogram part (_sum, _count and
    cumulative-``le`` buckets). ``arrival`` is unix seconds (the micro-batch
    time unless given; :mod:`meterline.streaming.arrival` keeps it through
    replays)."""
    arrival = arrival if arrival is not None else F.unix_seconds(F.current_timestamp())
    p = P.normalize_scope(P.contract_filter(P.keep_labels(points))).withColumn("arrival", arrival)
    keys = ["metric", "env", *P.LABELS]

    def row(part: str, le, value):
        return F.struct(F.lit(part).alias("part"), le.alias("le"), value.cast("double").alias("value"))

    none = F.lit("")
    # Lambdas are interpreted: buckets are worked out before, so that the rows of all points are made in generated code.
    p = p.withColumn("_buckets", F.when(F.col("kind") == "histogram", F.transform(
        A.bucket_pairs(), lambda b: row("bucket", b["le"], b["count"]))))
    parts = (F.when(F.col("kind") == "sum", F.array(row("", none, F.col("value"))))
             .when(F.col("kind") == "histogram", F.concat(
                 F.array(row("sum", none, F.col("h_sum")), row("count", none, F.col("h_count"))), F.col("_buckets"))))
    return p.select(*keys, "arrival", F.inline(parts))


def _state_fn(keys: Sequence[str], max_stale: int):
    """Builds the per-stream state function as a closure over plain values
    (shipped to Python workers by value)."""
    names = list(keys)

    def fold(key, pdfs, state):
        import pandas as pd
        batch = pd.concat([p[["arrival", "value"]] for p in pdfs])  # a row per arrival
        per = batch.groupby("arrival", sort=True)["value"].sum()
        total, last = (state.get if state.exists else (0.0, None))
        rows = []
        for arrival, delta in per.items():
            arrival = int(arrival)
            if last is not None and arrival - last > max_stale:
                total = 0.0
            total += float(delta)
            last = arrival
            rows.append((*key, arrival, total))
        state.update((total, last))
        yield pd.DataFrame(rows, columns=[*names, "t", "value"])

    return fold


def cumulative_stream(rows: DataFrame, keys: Sequence[str] = STREAM_KEYS,
                      max_stale: int = 86_400) -> DataFrame:
    """Delta rows -> cumulative per stream with stale restart, using
    ``applyInPandasWithState``. Within a micro-batch the deltas of a stream
    are summed per arrival before they are grouped by stream, however many
    they are; state is kept for good (:mod:`meterline.streaming.totals` has
    the form whose state expires)."""
    from .totals import compact_stream

    rows = compact_stream(rows, keys)
    out_schema = ", ".join(f"{k} string" for k in keys) + ", t bigint, value double"
    return rows.groupBy(*keys).applyInPandasWithState(
        _state_fn(keys, max_stale), out_schema, "total double, last bigint", "update",
        "NoTimeout")


def cumulative_stream_plain(rows: DataFrame, keys: Sequence[str] = STREAM_KEYS) -> DataFrame:
    """T2 without staleness: a streaming aggregate in update mode keeps the
    running sum per stream in the state store."""
    return rows.groupBy(*keys).agg(F.sum("value").alias("value"))


def idempotent_sink(path: str):
    """foreachBatch writer: batch ``n`` lands in ``batch_id=n`` with
    overwrite, so replaying a batch after a restart cannot double count."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def start_collector(spark: SparkSession, source: str, sink: str, checkpoint: str,
                    max_stale: int = 86_400, available_now: bool = True,
                    arrival: F.Column | None = None) -> StreamingQuery:
    """Run the streaming collector from landed OTLP JSON files into an
    idempotent Parquet sink of cumulative series."""
    rows = point_delta_rows(read_otlp_stream(spark, source), arrival)
    cum = cumulative_stream(rows, max_stale=max_stale)
    writer = cum.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(idempotent_sink(sink))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def latest_state(spark: SparkSession, sink: str) -> DataFrame:
    """Current cumulative per stream from the sink (last arrival wins)."""
    df = spark.read.parquet(sink)
    return df.groupBy(*STREAM_KEYS).agg(F.max("t").alias("t"), F.max_by("value", "t").alias("value"))


def commit_count_stream(spark: SparkSession, path: str, env: str,
                        arrival: F.Column | None = None) -> DataFrame:
    """S5 -> A10 -> T2 as a stream: each valid commit event is a delta of 1
    to ``codex.git.commit.count`` (content stripped, P6), folded into the
    same keyed cumulative state as the metric lane."""
    events = stream_commit_events(spark, path)
    arrival = arrival if arrival is not None else F.unix_seconds(F.col("arrival_ts"))
    rows = events.select(F.lit("codex.git.commit.count").alias("metric"), F.lit(env).alias("env"),
                         arrival.alias("arrival"), F.lit(1.0).alias("value"))
    return cumulative_stream(rows, keys=["metric", "env"])
