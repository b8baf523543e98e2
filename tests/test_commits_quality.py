"""Commit lane (verb filter, pairing, attribution, dedupe ids, capped
append) and data-quality jobs (price manifests, leak scan)."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from meterline.operators import commits as C
from meterline.operators.dedup import commit_dedupe_ids
from meterline.operators.quality import leak_scan, price_drift, validate_prices
from meterline.sources.commit_events import read_commit_events
from meterline.sources.prices import manifest_path, price_rows


@pytest.mark.parametrize("command,expected", [
    ("git commit -m x", True), ("git -C repo commit -am y", True), ("cd a && git commit", True),
    ("/usr/bin/git -c user.name=x merge main", True), ("git status", False), ("ls -la", False),
    ("git log; echo commit", False), ("echo git commit", True), ("git --no-pager rebase -i", True),
])
def test_commit_verbs(command, expected):
    assert C.may_create_commit(command) is expected


def calls(spark, rows):
    return spark.createDataFrame(rows, "hook_event_name string, tool_name string, command string, cwd string, "
                                       "repo string, session_id string, tool_use_id string, turn_id string, "
                                       "ts long")


def test_pairing_ignores_orphans_and_stale_pre(spark):
    base = ("Bash", "git commit -m x", "/w", "repo", "s")
    rows = [("PreToolUse", *base, "u1", "t", 100), ("PostToolUse", *base, "u1", "t", 160),
            ("PostToolUse", *base, "u2", "t", 200),                                   # no pre
            ("PreToolUse", *base, "u3", "t", 0), ("PostToolUse", *base, "u3", "t", 90_000),  # stale
            ("PreToolUse", "Bash", "ls", "/w", "repo", "s", "u4", "t", 1),
            ("PostToolUse", "Bash", "ls", "/w", "repo", "s", "u4", "t", 2)]
    paired = C.pair_tool_calls(calls(spark, rows)).collect()
    assert [(r["started"], r["ended"]) for r in paired] == [(100, 160)]
    inv = hashlib.sha256("\0".join(["u1", "t", "git commit -m x", "/w"]).encode()).hexdigest()[:24]
    assert paired[0]["invocation_id"] == inv


def test_attribution_window_and_replay_counted_once(spark):
    call = spark.createDataFrame([("i1", "repo", 100, 160), ("i2", "repo", 150, 400)],
                                 "invocation_id string, repo string, started long, ended long")
    commits = spark.createDataFrame([("repo", "a", 90), ("repo", "b", 120), ("repo", "c", 164),
                                     ("repo", "d", 170), ("other", "e", 130)],
                                    "repo string, sha string, committed_at long")
    att = C.attribute_commits(call, commits)
    assert sorted((r["invocation_id"], r["sha"]) for r in att.collect()) == [
        ("i1", "b"), ("i1", "c"), ("i2", "c"), ("i2", "d")]
    ids = commit_dedupe_ids(att, b"k")
    new = ids.select("dedupe_id", F.col("committed_at").alias("order"))
    existing = ids.limit(0).select("dedupe_id")
    assert C.append_commit_events(existing, new).count() == 3      # c once


def test_dedupe_ids_match_python_hmac(spark):
    df = spark.createDataFrame([("/repo", "abc"), ("/r2", "def")], "repo string, sha string")
    key = b"secret-key"
    want = {r: hmac.new(key, f"{r}\0{s}".encode(), hashlib.sha256).hexdigest() for r, s in
            [("/repo", "abc"), ("/r2", "def")]}
    ids = commit_dedupe_ids(df, key)
    assert {r["repo"]: r["dedupe_id"] for r in ids.collect()} == want
    plan = ids._jdf.queryExecution().toString()
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    assert not any(p.hex() in plan.lower() or p[:10].decode("latin1") in plan for p in pads) and "Python" not in plan
    long = b"k" * 100
    assert commit_dedupe_ids(df, long).where("repo = '/r2'").first()["dedupe_id"] == hmac.new(long, b"/r2\0def", hashlib.sha256).hexdigest()


def test_identity_values_by_place_and_key(spark):
    from meterline.operators.quality import identity_values
    rows = spark.createDataFrame([({"host": "h1", "x": "ok"}, {"mail": "a@b"}, "h1", "fine"), ({"host": "h2"}, {}, "fine", "fine"),
                                  ({"host": "h1"}, None, "fine", None)],
                                 "resource map<string,string>, attrs map<string,string>, model string, type string")
    secrets = spark.createDataFrame([("h1",), ("h1",), ("a@b",), ("h2",), ("unused",)], "secret string")
    got = sorted(map(tuple, identity_values(rows.na.fill("").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>"))),
                                            secrets, ["resource", "attrs"], ["model", "type"]).collect()))
    assert got == [("attrs", "mail", 1, 1), ("label", "model", 1, 1), ("resource", "host", 3, 2)]


def test_append_takes_unseen_ids_once(spark):
    existing = spark.createDataFrame([("a",), ("not-hex",)], "dedupe_id string")
    new = spark.createDataFrame([("b", 3), ("b", 2), ("not-hex", 1), ("a", 0), ("c", 9)], "dedupe_id string, order long")
    out = C.append_commit_events(existing, new).orderBy("order").collect()
    assert [(r["dedupe_id"], r["order"]) for r in out] == [("b", 2), ("c", 9)]


def test_commits_in_the_second_of_the_snapshot_count(spark):
    call = spark.createDataFrame([("i1", "repo", 100, 160), ("i2", "repo", 161, 170)],
                                 "invocation_id string, repo string, started long, ended long")
    commits = spark.createDataFrame([("repo", "a", 100), ("repo", "b", 97), ("repo", "c", 94), ("repo", "d", 158)],
                                    "repo string, sha string, committed_at long")
    got = sorted((r["invocation_id"], r["sha"]) for r in C.attribute_commits(call, commits).collect())
    assert got == [("i1", "a"), ("i1", "b"), ("i1", "d")]     # d was known when i2 started


def test_repeated_invocation_pairs_in_turn(spark):
    base = ("Bash", "git commit -m x", "/w", "repo", "s", "u1", "t")
    rows = [("PreToolUse", *base, 100), ("PostToolUse", *base, 110), ("PreToolUse", *base, 200),
            ("PostToolUse", *base, 230), ("PostToolUse", *base, 240)]
    got = sorted((r["started"], r["ended"]) for r in C.pair_tool_calls(calls(spark, rows)).collect())
    assert got == [(100, 110), (200, 230)]


def test_commit_log_tolerates_malformed_lines(spark):
    d = tempfile.mkdtemp()
    good = hashlib.sha256(b"x").hexdigest()
    with open(os.path.join(d, "events.jsonl"), "w") as fh:
        fh.write(json.dumps({"dedupe_id": good, "event": "codex.git.commit"}) + "\n{broken\n" +
                 json.dumps({"dedupe_id": None, "event": "codex.git.commit"}) + "\n")
    assert [r["dedupe_id"] for r in read_commit_events(spark, d).collect()] == [good]


def _manifest(tmp, provider, mutate):
    with open(manifest_path(provider)) as fh:
        doc = json.load(fh)
    mutate(doc)
    path = os.path.join(tmp, f"{provider}.json")
    with open(path, "w") as fh:
        json.dump(doc, fh)
    return path


@pytest.mark.parametrize("mutate,rule", [
    (lambda d: d["models"].append(dict(d["models"][0])), "duplicate_model"),
    (lambda d: d["models"][0].update(official_url="https://example.com/p"), "official_url"),
    (lambda d: d["models"][0].pop("verified_at"), "missing_fields"),
    (lambda d: d["models"][0].update(pricing_tier="premium"), "pricing_tier"),
    (lambda d: d["models"][0].update(effective_from="2026-02-01", effective_to="2026-01-01"),
     "date_range_inverted"),
    (lambda d: d["models"][0]["prices"].update(input=2.0), "not_decimal_string:input"),
    (lambda d: d["models"][0]["prices"].update(input="0"), "not_positive:input"),
    (lambda d: d["models"][0]["prices"].update(batch="1.00"), "unknown_type:batch"),
    (lambda d: d["models"][0]["prices"].pop("output"), "prices_input_output"),
    (lambda d: d.update(schema_version=2), "schema_version"),
])
def test_broken_manifests_are_rejected(spark, mutate, rule):
    path = _manifest(tempfile.mkdtemp(), "xai", mutate)
    rules = {r["rule"] for r in validate_prices(spark, path, "xai").collect()}
    assert rule in rules


@pytest.mark.parametrize("provider", ["openai", "xai"])
def test_tracked_manifests_are_valid_and_not_drifted(spark, provider):
    assert validate_prices(spark, manifest_path(provider), provider).count() == 0
    p = price_rows(spark)
    assert price_drift(p, price_rows(spark)).count() == 0


def test_leak_scan_rules(spark):
    docs = spark.createDataFrame([
        (1, "-----BEGIN RSA PRIVATE KEY-----"), (2, "key sk-proj-" + "a" * 24), (3, "ghp_" + "b" * 24),
        (4, "AKIA" + "C" * 16), (5, "see /home/alice/notes"), (6, "password: CHANGEME"),
        (7, "mail bob@corp.io now"), (8, "mail ok@example.invalid and x@users.noreply.github.com"),
        (9, "clean text"), (10, "café@exämple.io")], "id long, text string")
    got = {(r["id"], r["rule"]) for r in leak_scan(docs).collect()}
    assert {(1, "private_key"), (2, "openai_key"), (3, "github_token"), (4, "aws_key"),
            (5, "home_path"), (6, "weak_password"), (7, "email"), (10, "email")} <= got
    assert not any(i in (8, 9) for i, _ in got)
