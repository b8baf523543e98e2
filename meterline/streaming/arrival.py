"""T13 in the stream: producer times give way to the time of arrival.

A micro-batch is stamped once. The stamp is written beside the landed rows
under the batch id before they are, and read again when the batch is replayed
after a failure, so a rerun lands the same rows with the same times, whatever
the clock says by then. Stamps always go on: a batch is stamped with the
clock, or a second after the last stamp where that is later, so a stream has
one sample per time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collector import STREAM_KEYS, idempotent_sink, point_delta_rows, read_otlp_stream
from .totals import restarting_totals, rocksdb_state

_STAMP = "batch_id bigint, arrival bigint"


def stamp_arrival(df: DataFrame, arrival: int) -> DataFrame:
    """The rows of one batch with their ``arrival`` (unix seconds)."""
    return df.withColumn("arrival", F.lit(arrival).cast("bigint"))


def batch_stamp(spark: SparkSession, folder: str, batch_id: int, clock: Callable[[], float]) -> int:
    """The arrival of a batch: the one written for it, else a new one."""
    path = f"{folder.rstrip('/')}/stamps"
    try:
        known = spark.read.schema(_STAMP).parquet(path)
    except AnalysisException:  # the first batch
        known = spark.createDataFrame([], _STAMP)
    own, last = known.agg(F.max(F.when(F.col("batch_id") == batch_id, F.col("arrival"))), F.max("arrival")).first()
    if own is not None:
        return own
    stamp = max(int(clock()), (last or 0) + 1)
    spark.createDataFrame([(batch_id, stamp)], _STAMP).coalesce(1).write.mode("append").parquet(path)
    return stamp


def stamped_sink(folder: str, clock: Callable[[], float] = time.time):
    """foreachBatch writer of stamped batches, replays included."""
    land = idempotent_sink(f"{folder.rstrip('/')}/rows")

    def write(df: DataFrame, batch_id: int) -> None:
        land(stamp_arrival(df, batch_stamp(df.sparkSession, folder, batch_id, clock)), batch_id)
    return write


def _run(stream: DataFrame, mode: str, sink, checkpoint: str) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def collect_arrivals(spark: SparkSession, source: str, folder: str, clock: Callable[[], float] = time.time) -> DataFrame:
    """The collector lane from landed OTLP files to cumulative samples
    (``STREAM_KEYS``, t, value), up to what has landed: new files are turned
    into delta rows and stamped, and the stamped rows folded into totals with
    stale restart. Both streams go on from their checkpoints."""
    folder = folder.rstrip("/")
    rows = point_delta_rows(read_otlp_stream(spark, source), arrival=F.lit(0))
    _run(rows.drop("arrival"), "append", stamped_sink(folder, clock), f"{folder}/ckpt-land")
    schema = ", ".join(f"{k} string" for k in STREAM_KEYS) + ", value double, arrival bigint"
    landed = spark.readStream.schema(schema).parquet(f"{folder}/rows/batch_id=*")
    with rocksdb_state(spark):
        _run(restarting_totals(landed), "append", idempotent_sink(f"{folder}/totals"), f"{folder}/ckpt-totals")
    out = ", ".join(f"{k} string" for k in STREAM_KEYS) + ", t bigint, value double"
    return spark.read.schema(out).parquet(f"{folder}/totals").select(*STREAM_KEYS, "t", "value")
