"""Collector semantics on OTLP JSON payloads: privacy allowlist, contract
filter, compaction of concurrent producers, histogram merge, cumulative
state, batch and streaming."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from meterline.operators import aggregate as A
from meterline.operators import labels as P
from meterline.operators import series as T
from meterline.operators.quality import identity_leaks
from meterline.plans import jobs
from meterline.sources.otlp import flatten_otlp, read_otlp_json
from meterline.streaming import collector as S

METRIC = "claude_code.token.usage"


def kv(d):
    return [{"key": k, "value": {"stringValue": v}} for k, v in d.items()]


def payload(value, time_ns, metric=METRIC, temporality=1, resource_id="r", session="s",
            email="p@example.invalid", scope="scope-secret", extra=None):
    attrs = {"model": "claude-test", "type": "output", "session.id": session,
             "user.account_uuid": "acct", "agent.name": "planner", "agent_name": "zz-agent",
             "cost_kind": "zz-cost", "source": "zz-source"}
    attrs.update(extra or {})
    return {"resourceMetrics": [{
        "resource": {"attributes": kv({"service.instance.id": resource_id, "user.email": email, "env": "x"})},
        "scopeMetrics": [{"scope": {"name": scope, "version": "9", "attributes": kv({"k": "v"})},
                          "metrics": [{"name": metric, "sum": {
                              "aggregationTemporality": temporality, "isMonotonic": True,
                              "dataPoints": [{"attributes": kv(attrs), "startTimeUnixNano": str(time_ns - 10),
                                              "timeUnixNano": str(time_ns), "asInt": str(value)}]}}]}]}]}


def histogram(count, total, buckets, time_ns):
    return {"resourceMetrics": [{"resource": {"attributes": kv({"env": "x"})}, "scopeMetrics": [{
        "scope": {"name": "codex"}, "metrics": [{"name": "codex.turn.token_usage", "histogram": {
            "aggregationTemporality": 1, "dataPoints": [{
                "attributes": kv({"token_type": "total", "model": "gpt-5.6-sol"}),
                "startTimeUnixNano": "1", "timeUnixNano": str(time_ns), "count": str(count), "sum": total,
                "bucketCounts": [str(b) for b in buckets], "explicitBounds": [5.0, 50.0]}]}}]}]}]}


def write(dirname, docs, start=0):
    os.makedirs(dirname, exist_ok=True)
    for i, d in enumerate(docs):
        with open(os.path.join(dirname, f"p{start + i:04d}.json"), "w") as fh:
            json.dump(d, fh)


def batch_samples(spark, path):
    pts = flatten_otlp(read_otlp_json(spark, path))
    return jobs.otlp_samples(pts)


def test_two_producers_compact_to_one_private_series(spark):
    d = tempfile.mkdtemp()
    write(d, [payload(11, 4_000_000_000, resource_id="resource-b", session="session-b"),
              payload(31, 5_000_000_000, resource_id="host-7", session="session-a")])
    pts = flatten_otlp(read_otlp_json(spark, d))
    assert identity_leaks(pts).count() > 0
    kept = P.keep_labels(pts)
    assert identity_leaks(kept).count() == 0
    s = batch_samples(spark, d).collect()
    assert len(s) == 1 and s[0]["value"] == 42 and s[0]["agent_name"] == "planner"
    flat = json.dumps([r.asDict() for r in s])
    for secret in ["host-7", "session-b", "p@example.invalid", "scope-secret", "zz-agent",
                   "zz-cost", "zz-source"]:
        assert secret not in flat


def test_later_deltas_and_many_sends_add_up(spark):
    d = tempfile.mkdtemp()
    minute = 60_000_000_000
    docs = [payload(7, 1), payload(13, 2), payload(29, minute + 1), payload(3, minute + 2)]
    docs += [payload(2, 2 * minute + i) for i in range(17)]
    write(d, docs)
    s = batch_samples(spark, d)
    last = s.orderBy(F.col("t").desc()).first()
    assert last["value"] == 86 and s.count() == 3


def test_rejects_cumulative_and_unknown_metrics(spark):
    d = tempfile.mkdtemp()
    write(d, [payload(2, 1, temporality=2), payload(3, 1, metric="unknown.metric"), payload(4, 1)])
    pts = P.contract_filter(P.keep_labels(flatten_otlp(read_otlp_json(spark, d))))
    assert [r["value"] for r in pts.collect()] == [4.0]


def test_histograms_merge_and_cumulative_buckets(spark):
    d = tempfile.mkdtemp()
    write(d, [histogram(4, 55.5, [3, 1, 0], 5), histogram(6, 101.0, [1, 2, 3], 6)])
    s = {(r["name"], r["le"]): r["value"] for r in batch_samples(spark, d).collect()}
    assert s[("codex_turn_token_usage_sum", "")] == 156.5
    assert s[("codex_turn_token_usage_count", "")] == 10
    assert (s[("codex_turn_token_usage_bucket", "5")], s[("codex_turn_token_usage_bucket", "50")],
            s[("codex_turn_token_usage_bucket", "+Inf")]) == (4, 7, 10)


def test_session_counts_from_two_producers(spark):
    d = tempfile.mkdtemp()
    write(d, [payload(6, 1, metric="claude_code.session.count", extra={"start_type": "fresh"}),
              payload(9, 2, metric="claude_code.session.count", extra={"start_type": "fresh"})])
    assert [r["value"] for r in batch_samples(spark, d).collect()] == [15.0]


def test_stale_stream_restarts(spark):
    deltas = spark.createDataFrame([("a", 0, 5.0), ("a", 60, 5.0), ("a", 60 + 90_000, 3.0), ("b", 120, 1.0)],
                                   "k string, t long, value double")
    got = {(r["k"], r["t"]): r["value"] for r in T.delta_to_cumulative(deltas, keys=["k"]).collect()}
    assert got == {("a", 0): 5, ("a", 60): 10, ("a", 90_060): 3, ("b", 120): 1}


def test_commit_log_counts_cumulatively(spark):
    log = spark.createDataFrame([({"env": "x", "path": "secret"}, 60 * i) for i in range(5)],
                                "resource map<string,string>, arrival_ts long")
    counted = A.count_events(P.strip_log_content(log), F.col("arrival_ts"))
    deltas = counted.select("metric", "env", F.col("batch_t").alias("t"), "value")
    got = [r["value"] for r in T.delta_to_cumulative(deltas, keys=["metric", "env"]).orderBy("t").collect()]
    assert got == [1, 2, 3, 4, 5]


def _run_stream(spark, src, sink, ckpt, arrival=None):
    q = S.start_collector(spark, src, sink, ckpt, arrival=arrival)
    q.awaitTermination(300)
    assert q.exception() is None


def test_stream_totals_survive_restart_and_equal_batch(spark):
    root = tempfile.mkdtemp()
    src, sink, ckpt = (os.path.join(root, x) for x in ("src", "sink", "ckpt"))
    minute = 60_000_000_000
    arrival = F.floor(F.col("time_ns") / 1_000_000_000).cast("bigint")
    write(src, [payload(7, 1), payload(13, 2)])
    _run_stream(spark, src, sink, ckpt, arrival)
    write(src, [payload(29, minute), payload(3, minute + 1)], start=10)
    _run_stream(spark, src, sink, ckpt, arrival)           # restart from the checkpoint
    write(src, [payload(2, 2 * minute + i) for i in range(17)], start=20)
    _run_stream(spark, src, sink, ckpt, arrival)
    _run_stream(spark, src, sink, ckpt, arrival)           # nothing new: no double count
    latest = S.latest_state(spark, sink).collect()
    assert [r["value"] for r in latest] == [86.0]


def test_commit_count_stream_counts_each_event_once(spark):
    import hashlib
    root = tempfile.mkdtemp()
    src, ckpt = os.path.join(root, "src"), os.path.join(root, "ckpt")
    os.makedirs(src)
    for i in range(5):
        with open(os.path.join(src, f"e{i}.jsonl"), "w") as fh:
            fh.write(json.dumps({"dedupe_id": hashlib.sha256(str(i).encode()).hexdigest(),
                                 "event": "codex.git.commit"}) + "\n{bad\n")
    sink = os.path.join(root, "sink")
    counts = S.commit_count_stream(spark, src, env="test")
    for _ in range(2):          # a second run over the same files adds nothing
        q = counts.writeStream.outputMode("update").foreachBatch(S.idempotent_sink(sink)) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination(300)
    assert spark.read.parquet(sink).agg(F.max("value")).first()[0] == 5.0


def test_attribute_values_of_any_type(spark):
    """Booleans, numbers, lists and maps are attributes, too: a boolean is_git
    reaches the thread series."""
    base = tempfile.mkdtemp(prefix="meterline-otlp-")
    value = {"i": {"intValue": "41"}, "j": {"intValue": 7}, "d": {"doubleValue": 2.5}, "b": {"boolValue": False}, "s": {"stringValue": ""},
             "l": {"arrayValue": {"values": [{"stringValue": "x"}]}}, "m": {"kvlistValue": {"values": []}}, "none": {}}
    attrs = [{"key": k, "value": v} for k, v in value.items()] + [{"key": "is_git", "value": {"boolValue": True}},
                                                                  {"key": "s", "value": {"stringValue": "last"}}]
    start = {"attributes": attrs, "startTimeUnixNano": "1", "timeUnixNano": "60000000000", "asDouble": 3.0}
    doc = {"resourceMetrics": [{"resource": {"attributes": kv({"env": "x"})}, "scopeMetrics": [{"scope": {"name": "c"}, "metrics": [
        {"name": "codex.thread.started", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [start]}},
        {"name": "codex.turn.token_usage", "histogram": {"aggregationTemporality": 1, "dataPoints": []}},
        {"name": "empty"}]}]}]}
    write(base, [doc, histogram(4, 50, [1, 2, 1], 61_000_000_000)])
    points = flatten_otlp(read_otlp_json(spark, base))
    got = {r["kind"]: r for r in points.collect()}
    assert points.count() == 2 and got["histogram"]["bucket_counts"] == [1, 2, 1] and got["histogram"]["value"] is None
    seen = got["sum"]["attrs"]
    assert {k: seen.get(k) for k in ("i", "j", "d", "b", "s", "is_git")} == {"i": "41", "j": "7", "d": "2.5", "b": "false", "s": "last", "is_git": "true"}
    assert "none" not in seen and json.loads(seen["l"]) == [{"stringValue": "x"}] and json.loads(seen["m"]) == []
    threads = [r for r in batch_samples(spark, base).where("name = 'codex_thread_started_total'").collect()]
    assert [(r["is_git"], r["value"]) for r in threads] == [("true", 3.0)]
    assert points._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2  # one file scan, shown once or twice
