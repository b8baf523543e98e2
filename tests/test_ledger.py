"""Ledger scan on JSONL fixture trees (discovery, parsing, replay dedup,
totals, hourly history, exposition) — cases read from the scanner code."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from meterline.operators import aggregate as A
from meterline.operators import series as T
from meterline.operators.dedup import dedup_replays, scan_stats
from meterline.operators.labels import parse_cutoff
from meterline.sinks.text import exposition_text, openmetrics_history
from meterline.sources import ledger as L
from meterline.sources.exposition import parse_exposition


def usage(ts, inp=10, cached=0, out=5, reasoning=0, total=None, **extra):
    u = {"input_tokens": inp, "cached_input_tokens": cached, "output_tokens": out,
         "reasoning_output_tokens": reasoning, "total_tokens": inp + out if total is None else total}
    u.update(extra)
    return json.dumps({"timestamp": ts, "type": "event_msg",
                       "payload": {"type": "token_count", "info": {"last_token_usage": u}}})


def ctx(model, ts="2024-01-01T00:00:00Z"):
    return json.dumps({"timestamp": ts, "type": "turn_context", "payload": {"model": model}})


def tree(files: dict[str, list[str]]) -> str:
    root = tempfile.mkdtemp(prefix="ledger-")
    for rel, lines in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as fh:
            fh.write("\n".join(lines) + "\n")
    return root


def scan(spark, root):
    recs = L.usage_records(L.discover(L.read_ledger_lines(spark, root)))
    return recs, dedup_replays(recs)


def test_model_carry_unknown_before_first_context_and_change(spark):
    root = tree({"sessions/a.jsonl": [usage("2024-01-01T00:00:01Z", 1), ctx("m1"),
                                      usage("2024-01-01T00:00:02Z", 2), ctx("m2"),
                                      usage("2024-01-01T00:00:03Z", 3)]})
    recs, kept = scan(spark, root)
    got = sorted((r["input"], r["model"]) for r in kept.collect())
    assert got == [(1, "unknown"), (2, "m1"), (3, "m2")]


def test_parse_errors_and_skips(spark):
    root = tree({"sessions/a.jsonl": [
        usage("2024-01-01T00:00:01Z", 1),
        '{"type":"event_msg","payload":{"type":"token_count","info":{"last_tok',   # truncated tail
        '["token_count"]',                                                        # array line
        json.dumps({"type": "event_msg", "payload": {"type": "token_count"}}),     # no info: skip
        json.dumps({"timestamp": 5, "payload": {"type": "token_count",
                                                "info": {"last_token_usage": {"input_tokens": 9}}}}),
        "plain text line",                                                        # no marker
    ]})
    recs, kept = scan(spark, root)
    s = scan_stats(recs, kept).first()
    assert s["parse_errors"] == 3 and s["records_kept"] == 1 and s["files_scanned"] == 1


def test_non_integer_tokens_count_zero(spark):
    root = tree({"sessions/a.jsonl": [usage("2024-01-01T00:00:01Z", inp=1.5, out="7", reasoning=True, total=9)]})
    _, kept = scan(spark, root)
    r = kept.first()
    assert (r["input"], r["output"], r["reasoning_output"]) == (0, 0, 0)


def test_active_copy_wins_over_archived_basename(spark):
    root = tree({"sessions/2024/x.jsonl": [ctx("active"), usage("2024-01-01T00:00:01Z", 4)],
                 "archived_sessions/x.jsonl": [ctx("archived"), usage("2024-01-01T00:00:09Z", 8)],
                 "archived_sessions/y.jsonl": [ctx("old"), usage("2024-01-01T00:00:05Z", 6)]})
    _, kept = scan(spark, root)
    assert sorted((r["input"], r["model"]) for r in kept.collect()) == [(4, "active"), (6, "old")]


def test_replay_first_in_component_order_wins(spark):
    rec = usage("2024-01-01T00:00:01Z", 42)
    root = tree({"sessions/a-b/c.jsonl": [ctx("string-first"), rec],
                 "sessions/a/b.jsonl": [ctx("component-first"), rec]})
    recs, kept = scan(spark, root)
    rows = kept.collect()
    assert len(rows) == 1 and rows[0]["model"] == "component-first" and rows[0]["copies"] == 2
    assert scan_stats(recs, kept).first()["duplicate_records"] == 1


def test_totals_hourly_grid_and_unparsable_timestamp(spark):
    root = tree({"sessions/a.jsonl": [
        ctx("m"), usage("2024-01-01T00:10:00Z", 10, cached=4, out=6, reasoning=2),
        usage("2024-01-01T02:30:00Z", 20, out=3), usage("not-a-time", 100, out=1),
        usage("2024-01-01T05:00:00Z", 7)]})
    _, kept = scan(spark, root)
    totals = {(r["model"], r["token_type"]): r["value"] for r in A.ledger_totals(kept).collect()}
    assert totals[("m", "input")] == 137                     # unparsable time still counts in totals
    assert ("m", "cache_write_input") not in totals          # zero-free
    end = parse_cutoff("2024-01-01T04:00:00")
    hourly = A.hourly_usage(kept, F.lit(end.replace(tzinfo=None)))
    assert A.hourly_parse_errors(kept).first()[0] == 1
    grid = T.hourly_grid(hourly, int(end.timestamp()), L.TOKEN_TYPES)
    got = {(r["t"], r["token_type"]): r["value"] for r in grid.collect()}
    h0 = 1704067200
    assert got[(h0, "input")] == 10 and got[(h0 + 3600, "input")] == 10    # idle hour carried
    assert got[(h0 + 7200, "input")] == 30 and (h0 + 10800, "input") in got
    assert (h0 + 14400, "input") not in got                                # cutoff exclusive


def test_cutoff_must_be_hour_aligned():
    import pytest
    with pytest.raises(ValueError):
        parse_cutoff("2024-01-01T00:30:00")


def test_corpus_shrunk_flags_decrease_forever(spark):
    snaps = spark.createDataFrame([(1, "m", "input", 10), (2, "m", "input", 12), (3, "m", "input", 11),
                                   (4, "m", "input", 20)], "scan long, model string, token_type string, value long")
    assert [r["shrunk"] for r in T.corpus_shrunk(snaps).orderBy("scan").collect()] == [0, 0, 1, 1]


def test_exposition_round_trip(spark):
    root = tree({"sessions/a.jsonl": [ctx('m"x'), usage("2024-01-01T00:10:00Z", 10, out=6)]})
    _, kept = scan(spark, root)
    lines = exposition_text(A.ledger_totals(kept), A.turn_records(kept), env="prod")
    back = parse_exposition(lines.withColumnRenamed("line", "value"), job="codex-ledger",
                            instance="host:9314")
    got = {(r["name"], r["labels"]["model"], r["labels"].get("token_type")): r["value"] for r in back.collect()}
    assert got[("codex_ledger_token_usage_total", 'm"x', "input")] == 10
    assert got[("codex_ledger_turn_records_total", 'm"x', None)] == 1


def test_exposition_gauges(spark):
    _, kept = scan(spark, tree({"sessions/a.jsonl": [ctx("m"), usage("2024-01-01T00:10:00Z", 10, out=6)]}))
    stats = spark.createDataFrame([(1, 2, 3, 0, 1, 1704067200.5, 0.25)], "scan_ok int, parse_errors long, duplicate_records long, "
                                  "corpus_shrunk int, files_scanned long, last_scan_timestamp_seconds double, scan_duration_seconds double")
    lines = exposition_text(A.ledger_totals(kept), A.turn_records(kept), "prod", stats).where("section > 3")
    got = [r["line"] for r in lines.orderBy("section", "model", "token_type").collect() if not r["line"].startswith("# HELP")]
    assert got[:2] == ["# TYPE codex_ledger_scan_ok gauge", "codex_ledger_scan_ok 1"]
    assert got[-4:] == ["# TYPE codex_ledger_last_scan_timestamp_seconds gauge", "codex_ledger_last_scan_timestamp_seconds 1704067200.500",
                        "# TYPE codex_ledger_scan_duration_seconds gauge", "codex_ledger_scan_duration_seconds 0.250"]


def test_openmetrics_history_ends_with_eof(spark):
    cats = spark.createDataFrame([(3600, "m", "input", 5), (3600, "m", "output", 2)],
                                 "t long, model string, type string, value long")
    lines = openmetrics_history(cats, env="prod").orderBy(
        F.col("t").asc_nulls_last(), "model", "pos").collect()
    assert lines[-1]["line"] == "# EOF"
    assert lines[0]["line"] == ('ai_token_usage_tokens_total{env="prod",instance="host.docker.internal:9314",'
                                'job="codex-ledger",model="m",source="codex",type="input"} 5 3600')


def test_ingest_changed_reparses_only_changed_files(spark):
    import time
    root = tree({"sessions/a.jsonl": [ctx("m"), usage("2024-01-01T00:00:01Z", 1)],
                 "sessions/b.jsonl": [ctx("m"), usage("2024-01-01T00:00:02Z", 2)]})
    manifest, recs = L.ingest_changed(spark, root, None, None)
    manifest, recs = manifest.cache(), recs.cache()      # the previous scan, persisted
    manifest.count(), recs.count()
    assert sorted(r["input"] for r in dedup_replays(recs).collect()) == [1, 2]
    time.sleep(1.1)
    with open(os.path.join(root, "sessions/a.jsonl"), "a") as fh:
        fh.write(usage("2024-01-01T00:00:03Z", 3) + "\n")
    os.remove(os.path.join(root, "sessions/b.jsonl"))
    _, recs2 = L.ingest_changed(spark, root, manifest, recs)
    assert sorted(r["input"] for r in dedup_replays(recs2).collect()) == [1, 3]


def test_ordered_text_sink_and_exposition_reader(spark):
    from meterline.sinks.text import write_ordered
    from meterline.sources.exposition import read_exposition
    root = tree({"sessions/a.jsonl": [ctx("m2"), usage("2024-01-01T00:10:00Z", 10, out=6),
                                      ctx("m1"), usage("2024-01-01T00:20:00Z", 3, out=1)]})
    _, kept = scan(spark, root)
    out = os.path.join(tempfile.mkdtemp(), "metrics")
    write_ordered(exposition_text(A.ledger_totals(kept), A.turn_records(kept), env="prod"), out,
                  ["section", "model", "token_type"])
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    text = "".join(open(os.path.join(out, f)).read() for f in parts).splitlines()
    assert text[0].startswith("# HELP codex_ledger_token_usage_total")
    series = [ln for ln in text if ln.startswith("codex_ledger_token_usage_total{")]
    assert series == sorted(series) and series[0].startswith('codex_ledger_token_usage_total{env="prod",model="m1"')
    got = {(r["labels"]["model"], r["labels"].get("token_type")): r["value"]
           for r in read_exposition(spark, out, "codex-ledger", "host:9314").collect()
           if r["name"] == "codex_ledger_token_usage_total"}
    assert got[("m2", "input")] == 10 and got[("m1", "output")] == 1


def test_lines_are_parsed_in_one_place(spark):
    """The filter on a record's kind must not repeat the parse below it."""
    from meterline.sources.ledger import parse_lines

    lines = spark.createDataFrame([("sessions/a.jsonl", 1, "{}")], "path string, ord long, line string")
    plan = parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "variant_get" in x.lower()]
