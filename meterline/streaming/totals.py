"""T2 with staleness as a stream: cumulative totals in keyed state that
shrinks.

Delta rows (stream labels, ``arrival`` in unix seconds, ``value``) are summed
before they reach the state:

1. every task of a micro-batch sums its rows per stream and arrival, Arrow
   batch by Arrow batch (a map-side combine, without state);
2. the sums are dealt out by stream *and* arrival, so a stream that sends a
   third of all rows spreads over all tasks, and summed again;
3. the state operator then gets one row per stream and arrival.

State is one value per stream (total and last arrival) in the RocksDB store.
A stream whose next delta comes more than ``max_stale`` seconds after its last
one restarts from that delta. An event-time timer clears a stream's state once
the watermark has passed its last arrival by ``max_stale``: what comes later
restarts anyway, so results are those of state that is kept forever while the
store only holds streams of the last ``max_stale`` seconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import MAX_STALE
from .collector import STREAM_KEYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _summer(by: list[str], whole: bool):
    """Arrow sums of ``value`` by the given columns: of each batch, or of all
    batches of a task (as many rows as it has groups)."""
    def total(batches):
        import pyarrow as pa

        def summed(table):
            out = table.group_by(by).aggregate([("value", "sum")])
            return out.rename_columns([*by, "value"]).combine_chunks()

        kept = None
        for batch in batches:
            part = summed(pa.Table.from_batches([batch]))
            if not whole:
                yield from part.to_batches()
            else:
                kept = part if kept is None else summed(pa.concat_tables([kept, part]))
        if kept is not None:
            yield from kept.to_batches()
    return total


def compact_stream(rows: DataFrame, keys: Sequence[str] = STREAM_KEYS) -> DataFrame:
    """A3 on a stream: one row per stream and arrival of a micro-batch."""
    by = [*keys, "arrival"]
    rows = rows.select(*by, F.col("value").cast("double").alias("value"))
    schema = rows.schema
    combined = rows.mapInArrow(_summer(by, whole=False), schema)
    return combined.repartition(*by).mapInArrow(_summer(by, whole=True), schema)


def _processor(names: list[str], max_stale: int):
    """The state operator as a class over plain values, shipped by value."""
    from pyspark.sql.streaming import StatefulProcessor

    class RunningTotals(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("total", "total double, last bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            # One row per arrival of this micro-batch, however hot the stream is.
            deltas = pd.concat([r[["arrival", "value"]] for r in rows]).groupby("arrival", sort=True)["value"].sum()
            total, last = tuple(self.state.get()) if self.state.exists() else (0.0, None)
            out = []
            for arrival, delta in deltas.items():
                if last is not None and arrival - last > max_stale:
                    total = 0.0
                total += float(delta)
                last = int(arrival) if last is None else max(last, int(arrival))
                out.append((*key, int(arrival), total))
            self.state.update((total, last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + max_stale) * 1000)
            yield pd.DataFrame(out, columns=[*names, "t", "value"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    return RunningTotals()


def restarting_totals(rows: DataFrame, keys: Sequence[str] = STREAM_KEYS, max_stale: int = MAX_STALE,
                      delay: str = "1 minute") -> DataFrame:
    """Delta rows -> (keys, t, value), one row per stream and arrival.

    ``arrival`` drives the watermark, ``delay`` behind the latest one; Spark
    drops rows behind it, so arrivals must come in order but for the delay (as
    times stamped on arrival do). The stream must be started inside
    :func:`rocksdb_state`."""
    names = list(keys)
    compact = compact_stream(rows, names).withColumn("at", F.timestamp_seconds("arrival")).withWatermark("at", delay)
    schema = ", ".join(f"{k} string" for k in names) + ", t bigint, value double"
    return compact.groupBy(*names).transformWithStateInPandas(_processor(names, max_stale), schema, "Append", "EventTime")
