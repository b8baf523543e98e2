"""T2 with staleness as a stream: equal to T1, whatever the micro-batches."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from meterline.operators.series import delta_to_cumulative
from meterline.streaming.collector import idempotent_sink
from meterline.streaming.totals import compact_stream, restarting_totals, rocksdb_state

SCHEMA = "metric string, arrival bigint, value double"
DAY = 86_400


def run(spark, base, sink=None):
    stream = spark.readStream.schema(SCHEMA).parquet(base + "/land")
    with rocksdb_state(spark):
        q = (restarting_totals(stream, ["metric"]).writeStream.outputMode("append")
             .foreachBatch(sink or idempotent_sink(base + "/out")).option("checkpointLocation", base + "/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    assert q.exception() is None


def land(spark, base, rows, parts=4):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(base + "/land")


def result(spark, base):
    return sorted(map(tuple, spark.read.parquet(base + "/out").select("metric", "t", "value").collect()))


def state(spark, base):
    rows = spark.read.format("statestore").option("path", base + "/ck").option("stateVarName", "total").load()
    return {r["key"]["metric"]: (r["value"]["total"], r["value"]["last"]) for r in rows.collect()}


def test_restarts_expires_and_goes_on_after_a_stop(spark):
    rng = random.Random(3)
    base = tempfile.mkdtemp(prefix="meterline-stream-")
    drops = []
    for day in (0, 2, 6):
        at = lambda a, b: (day * DAY + rng.randrange(a, b)) // 60 * 60 + 60
        rows = [("hot", at(0, DAY), float(rng.randrange(9))) for _ in range(3000)]  # most rows of the batch
        rows += [(f"s{k}", at(0, DAY), 1.0) for k in range(5) for _ in range(rng.randrange(4))]
        drops.append(rows + ([("once", 600, 4.0)] if not day else []))
    drops[1].append(("edge", 2 * DAY, 1.0))
    drops[1].append(("edge", 3 * DAY, 2.0))            # idle for max_stale: goes on
    drops[2].append(("edge", 6 * DAY + 60, 5.0))       # idle for more: restarts
    for rows in drops:
        land(spark, base, rows)
        run(spark, base)
    flat = [r for rows in drops for r in rows]
    deltas = spark.createDataFrame(flat, SCHEMA).groupBy("metric", "arrival").sum("value").toDF("metric", "t", "value")
    want = sorted((r["metric"], r["t"], r["value"]) for r in delta_to_cumulative(deltas, ["metric"]).collect())
    assert result(spark, base) == want
    assert {m: v for m, t, v in want if m == "edge" and t >= 3 * DAY} == {"edge": 5.0}
    left = state(spark, base)
    assert "once" not in left and "hot" in left and left["edge"] == (5.0, 6 * DAY + 60)
    assert all(last >= 5 * DAY for _, last in left.values())  # the store has shrunk to live streams


def test_a_failed_batch_is_replayed_once(spark):
    base = tempfile.mkdtemp(prefix="meterline-stream-")
    write, failed = idempotent_sink(base + "/out"), []

    def fails_first(df, batch_id):
        write(df, batch_id)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the write")

    land(spark, base, [("a", 60, 1.0), ("a", 60, 2.0), ("a", 120, 3.0)])
    with pytest.raises(Exception):
        run(spark, base, fails_first)
    run(spark, base)
    assert failed == [0] and result(spark, base) == [("a", 60, 3.0), ("a", 120, 6.0)]


def test_a_hot_stream_reaches_the_state_as_one_row_an_arrival(spark):
    rows = [("hot", 60 * (i % 3), 1.0) for i in range(5000)] + [("b", 60, 2.0)]
    got = compact_stream(spark.createDataFrame(rows, SCHEMA).repartition(8), ["metric"]).collect()
    assert sorted(map(tuple, got)) == [("b", 60, 2.0), ("hot", 0, 1667.0), ("hot", 60, 1667.0), ("hot", 120, 1666.0)]


def test_arrivals_are_stamped_once_and_kept_through_a_replay(spark):
    from test_collector import payload, write

    from meterline.streaming import arrival
    from meterline.streaming.collector import point_delta_rows, read_otlp_stream

    base = tempfile.mkdtemp(prefix="meterline-arr-")
    times = iter([1000, 2000, 1500, 9000 + DAY, 9999 + 9 * DAY])
    clock = lambda: next(times)
    write(base + "/in", [payload(5, 10), payload(7, 99, session="other")])
    sink, failed = arrival.stamped_sink(base + "/c", clock), []

    def fails_first(df, batch_id):
        sink(df, batch_id)
        if not failed:
            failed.append(sorted(map(str, spark.read.parquet(f"{base}/c/rows/batch_id={batch_id}").collect())))
            raise RuntimeError("lost after the write")

    rows = lambda: point_delta_rows(read_otlp_stream(spark, base + "/in"), arrival=F.lit(0)).drop("arrival")
    with pytest.raises(Exception):
        arrival._run(rows(), "append", fails_first, base + "/c/ckpt-land")
    total = arrival.collect_arrivals(spark, base + "/in", base + "/c", clock)   # replays the batch
    assert sorted(map(str, spark.read.parquet(base + "/c/rows/batch_id=0").collect())) == failed[0]
    assert [(r["t"], r["value"]) for r in total.collect()] == [(1000, 12.0)]
    write(base + "/in", [payload(1, 11)], start=2)
    total = arrival.collect_arrivals(spark, base + "/in", base + "/c", clock)
    write(base + "/in", [payload(2, 12)], start=3)
    total = arrival.collect_arrivals(spark, base + "/in", base + "/c", clock)   # the clock went back: the stamp did not
    write(base + "/in", [payload(4, 12)], start=4)
    total = arrival.collect_arrivals(spark, base + "/in", base + "/c", clock)   # idle for more than a day: restarts
    assert sorted((r["t"], r["value"]) for r in total.collect()) == [(1000, 12.0), (2000, 13.0), (2001, 15.0), (9000 + DAY, 4.0)]


def test_points_land_slice_by_slice_in_bounded_files(spark, monkeypatch):
    import datetime as dt
    import glob
    import hashlib
    import os

    import pyarrow.parquet as pq

    from meterline.operators.series import delta_to_cumulative
    from meterline.plans import jobs
    from meterline.session import app_id, checkpoint_dir

    monkeypatch.setattr(jobs, "FILE_ROWS", 40, raising=False)
    sf, start = tempfile.mkdtemp(prefix="meterline-sf-"), dt.datetime(2024, 1, 1)
    kinds = ["click", "purchase", "view", "signup", "error"]
    rows = [(i, start + dt.timedelta(minutes=7 * (i // 2)) if i % 50 else None, i % 21, kinds[i % 5], float(i % 30), '{"k": %d}' % (i % 100))
            for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(sf + "/events.parquet")
    got = jobs.restart_stream_table(spark, sf)
    key = hashlib.sha1(repr((app_id(spark), os.path.abspath(sf))).encode()).hexdigest()[:12]
    files = [f for f in glob.glob(f"{checkpoint_dir(spark)}/meterline/restart-{key}/land/**", recursive=True) if f.endswith(".parquet")]
    sizes = [pq.read_metadata(f).num_rows for f in files]
    assert sum(sizes) == 980 and max(sizes) <= 40
    keys = ["metric", "part", "env", *jobs.P.LABELS, "le"]
    deltas = jobs.otlp_delta_rows(jobs.points_table(spark, sf)).where(F.col("t").isNotNull())
    want = delta_to_cumulative(deltas, keys).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
