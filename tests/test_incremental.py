"""After any change of the files the kept state equals a full scan."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile

from meterline.operators import aggregate as A
from meterline.operators.dedup import dedup_replays
from meterline.sources import ledger as L
from meterline.sources.incremental import LedgerState


def line(rng):
    if rng.random() < 0.25:
        return json.dumps({"type": "turn_context", "timestamp": "t", "payload": {"model": rng.choice(["m1", "m2"])}})
    if rng.random() < 0.1:
        return '{"type":"event_msg","payload":{"type":"token_count"'
    use = {"input_tokens": rng.randrange(3), "output_tokens": rng.randrange(2), "total_tokens": 1}
    return json.dumps({"type": "event_msg", "timestamp": f"2024-01-01T00:00:0{rng.randrange(4)}Z",
                       "payload": {"type": "token_count", "info": {"last_token_usage": use}}})


def rows(df):
    return sorted(map(str, df.select("path", "ts_raw", "model", "copies", *L.TOKEN_TYPES).collect()))


def full(spark, root):
    recs = L.usage_records(L.discover(L.read_ledger_lines(spark, root)))
    return recs, dedup_replays(recs)


def test_changes_of_any_kind_equal_a_full_scan(spark):
    rng = random.Random(8)
    base = tempfile.mkdtemp(prefix="meterline-led-")
    root = f"{base}/sessions/my home+1%20"      # below a folder of the ledger's own name
    clock = [1_700_000_000]

    def write(name, lines, mode="w"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", mode) as f:
            f.write("\n".join(lines) + ("\n" if rng.random() < 0.7 else ""))
        clock[0] += 5
        os.utime(f"{root}/{name}", (clock[0], clock[0]))

    some = lambda: [line(rng) for _ in range(rng.randrange(1, 12))]
    for name in ("sessions/a b.jsonl", "sessions/c.jsonl", "sessions/d/e+f.jsonl", "archived_sessions/k.jsonl", "archived_sessions/c.jsonl"):
        write(name, some())
    state = LedgerState(spark, f"{base}/state")
    steps = [lambda: None,
             lambda: write("sessions/a b.jsonl", [""] + some(), "a"),
             lambda: os.remove(f"{root}/sessions/c.jsonl"),                 # its archived copy counts again
             lambda: (write("sessions/n.jsonl", some()), write("sessions/d/k.jsonl", some())),  # k leaves the archive
             lambda: shutil.move(f"{root}/sessions/a b.jsonl", f"{root}/archived_sessions/a b.jsonl"),
             lambda: write("sessions/d/e+f.jsonl", some())]
    for i, change in enumerate(steps):
        change()
        assert state.scan(root) == i + 1
        recs, kept = full(spark, root)
        assert rows(state.kept()) == rows(kept)
        assert sorted(map(str, A.ledger_totals(state.kept()).collect())) == sorted(map(str, A.ledger_totals(kept).collect()))
        assert state.records().where("is_error").count() == recs.where("is_error").count()
    paths = {r["path"] for r in full(spark, root)[0].select("path").distinct().collect()}
    assert all(p.startswith(("sessions/", "archived_sessions/")) for p in paths) and "archived_sessions/a b.jsonl" in paths
    parsed = {r["file_path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{base}/state/records/version=6").select("file_path").distinct().collect()}
    assert parsed == {"e+f.jsonl"}              # only what changed was read
    # A scan that failed before its manifest does not count.
    shutil.rmtree(f"{base}/state/manifest/version=6")
    assert state.version() == 5 and state.scan(root) == 6
    small = state.compact(f"{base}/small")
    assert rows(small.kept()) == rows(full(spark, root)[1]) and small.scan(root) == 2
    assert rows(small.kept()) == rows(full(spark, root)[1])


def test_ranges_of_large_files_and_empty_ledgers(spark):
    rng = random.Random(9)
    base = tempfile.mkdtemp(prefix="meterline-led-")
    os.makedirs(f"{base}/sessions")
    with open(f"{base}/sessions/x.jsonl", "w") as f:
        f.write("\n".join(line(rng) for _ in range(60)))
    open(f"{base}/sessions/empty.jsonl", "w").close()
    files = L.discovered(spark, base)
    cut = L.read_files(files.drop("modificationTime"), range_bytes=100)
    whole = [r["line"] for r in L.read_ledger_lines(spark, base).orderBy("ord").collect()]
    assert [r["line"] for r in cut.orderBy("ord").collect()] == whole and cut.select("block").distinct().count() > 20
    assert rows(dedup_replays(L.usage_records(cut))) == rows(full(spark, base)[1])


def test_exporter_serves_all_gauges_and_the_last_good_scan(spark, monkeypatch):
    from meterline.plans.exporter import scan_and_expose

    base = tempfile.mkdtemp(prefix="meterline-exp-")
    os.makedirs(f"{base}/home/sessions")

    def put(name, n, out):
        use = {"input_tokens": n, "output_tokens": out, "total_tokens": n}
        row = {"type": "event_msg", "timestamp": f"2024-01-01T00:00:{n:02d}Z", "payload": {"type": "token_count", "info": {"last_token_usage": use}}}
        with open(f"{base}/home/sessions/{name}", "w") as f:
            f.write(json.dumps(row) + "\n")

    def expose():
        got = {}
        for r in scan_and_expose(spark, f"{base}/home", f"{base}/state", "e").collect():
            if not r["line"].startswith("#"):
                name, value = r["line"].rsplit(" ", 1)
                got[name.removeprefix("codex_ledger_")] = float(value)
        return got

    put("a.jsonl", 3, 2)
    put("b.jsonl", 3, 2)             # a replay of a
    first = expose()
    assert first['token_usage_total{env="e",model="unknown",token_type="input"}'] == 3
    gauges = ["scan_ok", "parse_errors", "duplicate_records", "corpus_shrunk", "files_scanned"]
    assert [first[g] for g in gauges] == [1, 0, 1, 0, 2]
    assert first["last_scan_timestamp_seconds"] > 1.7e9 and first["scan_duration_seconds"] > 0
    put("b.jsonl", 7, 1)
    put("bad.jsonl", 9, 9)
    real = L._read_ranges

    def unreadable(batches, keep):   # as a file without permission is to a task
        import meterline.sources.tail as tail
        opened = tail.open_file

        def refuse(uri):
            if uri.endswith("bad.jsonl"):
                raise PermissionError(uri)
            return opened(uri)
        tail.open_file = refuse
        try:
            yield from real(batches, keep)
        finally:
            tail.open_file = opened

    monkeypatch.setattr(L, "_read_ranges", unreadable)
    second = expose()
    assert [second[g] for g in gauges] == [1, 1, 0, 0, 3]
    assert second['token_usage_total{env="e",model="unknown",token_type="input"}'] == 10

    def broken(self, root):
        raise RuntimeError("no listing")
    with monkeypatch.context() as m:
        m.setattr(LedgerState, "scan", broken)
        third = expose()
    assert third.pop("scan_ok") == 0 and {**second, **third} == second  # figures and time of the last good scan
    os.remove(f"{base}/home/sessions/a.jsonl")
    fourth = expose()
    assert [fourth[g] for g in gauges] == [1, 1, 0, 1, 2]
    put("c.jsonl", 30, 30)
    assert expose()["corpus_shrunk"] == 1   # for good
    with monkeypatch.context() as m:
        m.setattr(LedgerState, "scan", broken)
        nothing = [r["line"] for r in scan_and_expose(spark, f"{base}/home", f"{base}/none", "e").collect()]
    assert "codex_ledger_scan_ok 0" in nothing
