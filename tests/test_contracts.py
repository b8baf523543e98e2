"""Configuration contracts: allowlists, metric contract, expiry vs
staleness, and the collector's filter order."""

from __future__ import annotations

import inspect
import re

from meterline.operators import labels as P
from meterline.operators import series as T
from meterline.plans import jobs


def test_point_allowlist_is_closed():
    keys = ["agent.name", "decision", "effort", "is_git", "model", "start_type", "token_type", "type"]
    assert [k for k, _ in P.LABEL_KEYS] == keys
    rx = re.compile(P.POINT_KEY_PATTERN)
    assert all(rx.match(k) for k in keys)
    for leaked in ["agent_name", "session.id", "user.email", "cost_kind", "source", "pricing_tier", "modelx"]:
        assert not rx.match(leaked)
    assert re.compile(P.RESOURCE_KEY_PATTERN).match("env") and not re.match(P.RESOURCE_KEY_PATTERN, "envx")


def test_metric_contract_has_eleven_families():
    rx = re.compile(P.CONTRACT_PATTERN)
    admitted = [m for m, _ in P.SERIES_NAMES if rx.match(m)]
    assert len(admitted) == 11 and "codex.git.commit.count" not in admitted
    assert not rx.match("claude_code.token.usage.extra") and not rx.match("unknown.metric")


def test_expiry_exceeds_staleness():
    assert T.EXPIRY > T.MAX_STALE


def test_collector_order_privacy_contract_scope():
    src = inspect.getsource(jobs.admitted_points)
    body = src[src.index("return"):]
    assert body.index("normalize_scope") < body.index("contract_filter") < body.index("keep_labels")
