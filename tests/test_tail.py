"""The tail source: lines appended to files arrive once, complete ones only."""

from __future__ import annotations

import io
import json
import os
import random
import tempfile

from meterline.sources import tail
from meterline.streaming.collector import idempotent_sink


def run(spark, base, **options):
    q = (tail.tail_lines(spark, base + "/in", **options).writeStream.foreachBatch(idempotent_sink(base + "/out"))
         .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None


def lines(spark, base):
    rows = spark.read.schema("path string, offset bigint, line string").parquet(base + "/out").collect()
    return sorted((os.path.basename(r["path"]), r["offset"], r["line"]) for r in rows)


def append(base, name, data: bytes):
    os.makedirs(os.path.dirname(f"{base}/in/{name}"), exist_ok=True)
    with open(f"{base}/in/{name}", "ab") as f:
        f.write(data)


def test_ranges_hold_every_line_once(monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 7)
    rng = random.Random(4)
    for _ in range(200):
        data = b"".join(rng.choice([b"\n", b"a", b"bcd", b"\n\n", b"x" * 20]) for _ in range(rng.randrange(40)))
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(5)))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in tail.lines_of(io.BytesIO(data), a, b)]
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def test_growing_files_are_tailed(spark):
    base = tempfile.mkdtemp(prefix="meterline-tail-")
    append(base, "a b.jsonl", "first\nsecond é\nthi".encode())
    append(base, "deep/c%20d.jsonl", b"one\r\n\ntwo\n")
    append(base, "other.txt", b"no\n")
    run(spark, base, maxRangeBytes="5")
    want = [("a b.jsonl", 0, "first"), ("a b.jsonl", 6, "second é"), ("c%20d.jsonl", 0, "one"), ("c%20d.jsonl", 6, "two")]
    assert lines(spark, base) == want
    run(spark, base)                                   # a restart repeats nothing
    assert lines(spark, base) == want
    append(base, "a b.jsonl", b"rd")                   # still no line feed
    run(spark, base)
    append(base, "a b.jsonl", b"!\nfourth\n")
    append(base, "new.jsonl", b"n1\n")
    run(spark, base, maxRangeBytes="3")
    want += [("a b.jsonl", 16, "third!"), ("a b.jsonl", 23, "fourth"), ("new.jsonl", 0, "n1")]
    assert lines(spark, base) == sorted(want)
    with open(f"{base}/in/new.jsonl", "wb") as f:      # written anew, shorter
        f.write(b"n\n")
    run(spark, base)
    assert lines(spark, base) == sorted([*want, ("new.jsonl", 0, "n")])


def test_start_at_the_end_and_commit_events(spark):
    base = tempfile.mkdtemp(prefix="meterline-tail-")
    event = lambda i: json.dumps({"dedupe_id": i, "event": "codex.git.commit"}).encode() + b"\n"
    append(base, "log.jsonl", event("old"))
    run(spark, base, start_at="end")
    append(base, "log.jsonl", event("x") + b'{"dedupe_id": "br\n' + b"[1]\n" + b'{"event": "codex.git.commit"}\n' +
           b'{"dedupe_id": "y", "event": "other"}\n' + event("z"))
    run(spark, base, start_at="end")
    out = spark.read.schema("path string, offset bigint, line string").parquet(base + "/out")
    assert sorted(r["dedupe_id"] for r in tail.commit_events_of(out).collect()) == ["x", "z"]
