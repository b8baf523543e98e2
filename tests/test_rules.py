"""Golden cases of the recording rules and panel queries, transcribed from
the reference's rule unit tests (series, evaluation time, expected value)."""

from __future__ import annotations

import math

import pytest
from conftest import samples
from pyspark.sql import functions as F

from meterline.operators import series as T
from meterline.operators.quality import price_conflicts
from meterline.plans import views
from meterline.sources.prices import price_rows

LEDGER = "codex_ledger_token_usage_total"
TEST = {"env": "test"}


def ledger_totals_at(spark, series, at, interval=60):
    s = samples(spark, [(LEDGER, {**TEST, **lab}, n) for lab, n in series], interval)
    inst = T.instant(s, at, lookback=300)
    return inst.select("env", "model", "token_type", "type", "value")


def cats(df):
    return {r["type"]: r["value"] for r in df.collect()}


def empty_grok(spark):
    return spark.createDataFrame([], "env string, model string, type string, value double")


def cost(spark, totals):
    basis = views.billing_basis(totals.groupBy("model", "token_type").agg(F.sum("value").alias("value")),
                                empty_grok(spark))
    rows = views.api_cost(basis, price_rows(spark)).collect()
    return sum(r["cost_usd"] for r in rows)


def test_spoofed_type_label_is_summed_away(spark):
    t = ledger_totals_at(spark, [({"model": "gpt-test", "token_type": "input"}, "10"),
                                 ({"model": "gpt-test", "token_type": "input", "type": "spoofed"}, "20")], 0)
    out = views.disjoint_codex(t.drop("type"), keys=["env", "model"]).collect()
    assert [(r["env"], r["model"], r["type"], r["value"]) for r in out] == [("test", "gpt-test", "input", 30.0)]


def test_gpt56_disjoint_categories_and_cost(spark):
    m = {"model": "gpt-5.6-sol"}
    t = ledger_totals_at(spark, [({**m, "token_type": "input"}, "100 180"),
                                 ({**m, "token_type": "cached_input"}, "40 60"),
                                 ({**m, "token_type": "cache_write_input"}, "10 30"),
                                 ({**m, "token_type": "output"}, "20 50"),
                                 ({**m, "token_type": "reasoning_output"}, "5 15"),
                                 ({**m, "token_type": "total"}, "120 230")], 60)
    c = cats(views.disjoint_codex(t.drop("type"), keys=["env", "model"]))
    assert c == {"input": 90, "cacheRead": 60, "cacheCreation": 30, "output": 35, "reasoning_output": 15}
    assert sum(c.values()) == 230
    assert cost(spark, t) == pytest.approx(0.0021675, abs=1e-12)


def test_grok_disjoint_categories_and_cost(spark):
    m = {"env": "test", "model": "grok-4.6"}
    s = samples(spark, [("grok_code_token_usage_total", {**m, "type": "input"}, "100 180"),
                        ("grok_code_token_usage_total", {**m, "type": "cache_read"}, "40 60"),
                        ("grok_code_token_usage_total", {**m, "type": "output"}, "20 50"),
                        ("grok_code_token_usage_total", {**m, "type": "reasoning"}, "5 15")], 60)
    latest = views.grok_latest(s, 60)
    assert cats(views.disjoint_grok(latest)) == {"input": 120, "cacheRead": 60, "output": 35,
                                                 "reasoning_output": 15}
    empty = ledger_totals_at(spark, [], 0).drop("type").withColumnRenamed("value", "value")
    basis = views.billing_basis(empty.select("model", "token_type", "value"), latest)
    total = sum(r["cost_usd"] for r in views.api_cost(basis, price_rows(spark)).collect())
    assert total == pytest.approx(0.00057, abs=1e-12)


def test_codex_without_cache_write(spark):
    m = {"model": "gpt-5.5"}
    t = ledger_totals_at(spark, [({**m, "token_type": "input"}, "100"),
                                 ({**m, "token_type": "cached_input"}, "40"),
                                 ({**m, "token_type": "output"}, "10"),
                                 ({**m, "token_type": "reasoning_output"}, "5"),
                                 ({**m, "token_type": "total"}, "110")], 0)
    c = cats(views.disjoint_codex(t.drop("type"), keys=["env", "model"]))
    assert c["input"] == 60 and "cacheCreation" not in c
    assert c["input"] + c["cacheRead"] + c["output"] + c["reasoning_output"] == 110
    assert cost(spark, t) == pytest.approx(0.00062, abs=1e-12)


def test_missing_cache_and_reasoning_keep_minuends(spark):
    m = {"model": "gpt-5.4-mini"}
    t = ledger_totals_at(spark, [({**m, "token_type": "input"}, "0 100 180"),
                                 ({**m, "token_type": "output"}, "0 20 50")], 120)
    c = cats(views.disjoint_codex(t.drop("type"), keys=["env", "model"]))
    assert c == {"input": 180, "output": 50}
    assert cost(spark, t) == pytest.approx(0.00036, abs=1e-12)


def test_capture_ratio(spark):
    s = samples(spark, [("codex_turn_token_usage_sum", {**TEST, "model": "gpt-5.6-sol", "token_type": "total"},
                         "0+32x60"),
                        (LEDGER, {**TEST, "model": "gpt-5.6-sol", "token_type": "total"}, "0+100x60")], 60)
    out = {r["t"]: r["ratio"] for r in views.capture_ratio(s).collect()}
    assert out[3600] == pytest.approx(0.32)
    assert math.isnan(out[0])          # idle: 0/0


def test_capture_ratio_zero_when_otlp_lane_silent(spark):
    s = samples(spark, [(LEDGER, {**TEST, "model": "gpt-5.6-sol", "token_type": "total"}, "0+100x60")], 60)
    out = {r["t"]: r["ratio"] for r in views.capture_ratio(s).collect()}
    assert out[3600] == 0.0


def test_effort_panel_hides_zero_and_pins_medium(spark):
    name = "claude_code_token_usage_tokens_total"
    s = samples(spark, [(name, {**TEST, "effort": "low", "model": "claude-test", "type": "output"}, "0 0 0 0 0"),
                        (name, {**TEST, "effort": "high", "model": "claude-test", "type": "output"},
                         "0 25 50 75 100")], 15)
    out = {(r["t"], r["effort"]): r["tokens"] for r in views.effort_split(s, step=60).collect()}
    assert out[(60, "high")] == 100 and out[(60, "medium")] == 0
    assert (60, "low") not in out


def test_sessions_threads_and_work_units(spark):
    s = samples(spark, [
        ("claude_code_session_count_total", {**TEST, "start_type": "fresh"}, "0 1 2 3 4"),
        ("claude_code_session_count_total", {**TEST, "start_type": "agents_view"}, "0 1 1 2 2"),
        ("claude_code_token_usage_tokens_total", {**TEST, "model": "claude-test", "type": "output"},
         "0 100 200 300 400"),
        ("codex_thread_started_total", {**TEST, "is_git": "true"}, "0 1 2 4 5"),
    ], 15)
    sessions = {r["t"]: r["sessions"] for r in views.session_starts(s, step=60).collect()}
    threads = {r["t"]: r["threads"] for r in views.thread_starts(s, step=60).collect()}
    assert sessions[60] == 4 and threads[60] == 5
    claude = views.hourly_increase(views.claude_token_series(s),
                                   ["source", "env", "model", "type", "effort", "agent_name"], step=60)
    tok = claude.where("t = 60").agg(F.sum("value")).first()[0]
    assert tok / max(sessions[60], 1) == 100
    # codex: derived categories of the ledger series, increase over 1m / threads
    led = samples(spark, [(LEDGER, {**TEST, "model": "gpt-5.3-codex", "token_type": tt}, n) for tt, n in [
        ("input", "0 50 100 150 200"), ("cached_input", "0 10 20 30 40"),
        ("output", "0 25 50 75 100"), ("reasoning_output", "0 5 10 15 20")]], 15)
    from meterline.plans.jobs import derive_categories
    wide = led.groupBy("env", "model", "t").pivot("token_type").agg(F.sum("value"))
    for c in ["cache_write_input", "total"]:
        wide = wide.withColumn(c, F.lit(0.0))
    ai = derive_categories(wide, ["env", "model", "t"])
    inc = T.range_eval(ai, 60, 60, "increase", keys=["env", "model", "type"])
    codex_tok = inc.where("t = 60").agg(F.sum("value")).first()[0]
    assert codex_tok / max(threads[60], 1) == 60


def test_first_commit_batch_is_counted(spark):
    s = samples(spark, [("codex_git_commit_count_total", TEST, "_ _ 5 5 _")], 15)
    out = {r["t"]: r["value"] for r in T.first_batch_growth(s, 60, 60, expiry=60).collect()}
    assert out == {60: 5.0}


def test_no_model_type_priced_twice(spark):
    assert price_conflicts(price_rows(spark)).count() == 0


@pytest.mark.parametrize("model,typ,price", [("gpt-5.6-sol", "cacheCreation", 6.25),
                                             ("gpt-5.4-mini", "input", 0.75),
                                             ("gpt-5.4-nano", "output", 1.25),
                                             ("grok-4.6", "cacheRead", 0.50)])
def test_price_gauges(spark, model, typ, price):
    r = price_rows(spark).where((F.col("model") == model) & (F.col("type") == typ)).collect()
    assert len(r) == 1 and float(r[0]["price"]) == price and r[0]["cost_kind"] == "api_estimate"


def test_and_on_empty_and_or_vector_zero(spark):
    from meterline.operators import vector as J
    a = spark.createDataFrame([(1.0,)], "value double")
    empty = a.limit(0)
    assert J.v_and_on(a, a).count() == 1 and J.v_and_on(a, empty).count() == 0
    assert J.or_zero(empty).first()["value"] == 0.0 and J.or_zero(a).first()["value"] == 1.0


def test_rename_rules_in_one_pass(spark):
    from meterline.operators.labels import RENAME_RULES, record, rename_rules
    rows = [(series, "claude_code", "e", 60, 1.0 + i) for i, (series, _, _) in enumerate(RENAME_RULES)] + [("other", "", "e", 60, 9.0)]
    s = spark.createDataFrame(rows, "name string, source string, env string, t long, value double")
    out = record(s, rename_rules(spark), ["source", "cost_kind", "env"])
    got = {(r["name"], r["source"]): (r["cost_kind"], r["env"], r["t"], r["value"]) for r in out.collect()}
    assert len(got) == out.count() == len(RENAME_RULES) == 9
    assert got[("ai_commit_count_total", "codex")] == ("", "e", 60, 4.0)          # the rule's label wins
    assert got[("ai_cost_usage_usd_total", "claude_code")] == ("emitter_estimate", "e", 60, 2.0)
    twice = rename_rules(spark, [("other", "a", {}), ("other", "b", {"env": "x"})])
    assert sorted(map(tuple, record(s, twice, ["env"]).select("name", "env", "value").collect())) == [("a", "e", 9.0), ("b", "x", 9.0)]
