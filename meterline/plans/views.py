"""Unified views and panel queries.

Instant views evaluate at the end of the data; panel views evaluate at every
hour with a one-hour range (T10), as a dashboard range query would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_min, prom_div
from ..operators import series as T
from ..operators import vector as J
from ..operators.labels import match, normalize_model, relabel
from ..sources.ledger import TOKEN_TYPES
from . import jobs

HOUR = 3600
AI_LABELS = ["source", "env", "model", "type", "effort", "agent_name"]


def _round(c, d=6):
    return F.round(c.cast("double"), d)


# ---- instant views ----------------------------------------------------------

def _pivot(df: DataFrame, keys: list[str], col: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(col, values).agg(F.sum("value"))


def disjoint_codex(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M1: disjoint categories from ledger totals. Absence is kept: a
    category whose source series is absent has no row; a missing subtrahend
    counts as 0 (``or x*0``); differences are clamped at 0."""
    keys = keys or ["model"]
    w = _pivot(totals, keys, "token_type", TOKEN_TYPES)
    cached, cw = F.col("cached_input"), F.col("cache_write_input")
    caches = F.when(cached.isNull() & cw.isNull(), F.lit(None)) \
        .otherwise(F.coalesce(cached, F.lit(0)) + F.coalesce(cw, F.lit(0)))
    cats = w.select(
        *keys,
        F.when(F.col("input").isNotNull(),
               clamp_min(F.col("input") - F.coalesce(caches, F.lit(0)), 0)).alias("input"),
        cached.alias("cacheRead"), cw.alias("cacheCreation"),
        F.when(F.col("output").isNotNull(),
               clamp_min(F.col("output") - F.coalesce(F.col("reasoning_output"), F.lit(0)), 0))
        .alias("output"),
        F.col("reasoning_output").alias("reasoning_output"))
    long = cats.unpivot(keys, jobs.CATEGORIES, "type", "value").where(F.col("value").isNotNull())
    return long.withColumn("source", F.lit("codex")).withColumn("value", F.col("value").cast("double"))


def grok_latest(samples: DataFrame, now: int) -> DataFrame:
    g = jobs.named(samples, "grok_code_token_usage_total")
    return T.expire(g.select("env", "model", "type", "t", "value"), now, keys=["env", "model", "type"])


def disjoint_grok(latest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M2: grok categories: input - cache_read, cacheRead, output - reasoning,
    reasoning_output; no cacheCreation."""
    keys = keys or ["env", "model"]
    return grok_categories(_pivot(latest, keys, "type", ["input", "cache_read", "output", "reasoning"]),
                           keys)


def grok_categories(w: DataFrame, keys: list[str]) -> DataFrame:
    """M2 derivation on a wide frame with input/cache_read/output/reasoning."""
    cats = w.select(
        *keys,
        F.when(F.col("input").isNotNull(),
               clamp_min(F.col("input") - F.coalesce(F.col("cache_read"), F.lit(0.0)), 0)).alias("input"),
        F.col("cache_read").alias("cacheRead"),
        F.when(F.col("output").isNotNull(),
               clamp_min(F.col("output") - F.coalesce(F.col("reasoning"), F.lit(0.0)), 0)).alias("output"),
        F.col("reasoning").alias("reasoning_output"))
    long = cats.unpivot(keys, ["input", "cacheRead", "output", "reasoning_output"], "type", "value") \
        .where(F.col("value").isNotNull())
    return long.withColumn("source", F.lit("grok_code")).withColumn("value", F.col("value").cast("double"))


def claude_latest(samples: DataFrame, now: int, name: str = "claude_code_token_usage_tokens_total"):
    c = jobs.named(samples, name).select("env", "model", "type", "effort", "agent_name", "t", "value")
    return T.expire(c, now, keys=["env", "model", "type", "effort", "agent_name"])


def ai_tokens(samples: DataFrame, totals: DataFrame, now: int) -> DataFrame:
    """M3: ai_token_usage_tokens_total at ``now``: Claude rename, codex and
    grok disjoint categories, as one family (J12)."""
    claude = relabel(claude_latest(samples, now).drop("t"), "ai_token_usage_tokens_total",
                     {"source": "claude_code"})
    codex = disjoint_codex(totals).withColumn("env", F.lit(jobs.LEDGER_ENV))
    grok = disjoint_grok(grok_latest(samples, now))
    u = J.union_sources(claude.drop("name"), codex, grok, labels=AI_LABELS)
    return u.select(*AI_LABELS, "value")


def billing_basis(totals: DataFrame, grok: DataFrame) -> DataFrame:
    """Tokens priced by M4: fresh input, cacheRead, cacheCreation and
    **gross** output (reasoning is inside output, never priced apart)."""
    cw = _pivot(totals, ["model"], "token_type", TOKEN_TYPES)
    caches = F.coalesce(F.col("cached_input"), F.lit(0)) + F.coalesce(F.col("cache_write_input"), F.lit(0))
    codex = cw.select("model",
                      F.when(F.col("input").isNotNull(), F.greatest(F.col("input") - caches, F.lit(0)))
                      .alias("input"),
                      F.col("cached_input").alias("cacheRead"),
                      F.col("cache_write_input").alias("cacheCreation"),
                      F.col("output").alias("output")) \
        .unpivot(["model"], ["input", "cacheRead", "cacheCreation", "output"], "type", "tokens") \
        .where(F.col("tokens").isNotNull()).withColumn("source", F.lit("codex"))
    gw = _pivot(grok, ["model"], "type", ["input", "cache_read", "output", "reasoning"])
    grok_b = gw.select("model",
                       F.when(F.col("input").isNotNull(),
                              F.greatest(F.col("input") - F.coalesce(F.col("cache_read"), F.lit(0.0)),
                                         F.lit(0.0))).alias("input"),
                       F.col("cache_read").alias("cacheRead"), F.col("output").alias("output")) \
        .unpivot(["model"], ["input", "cacheRead", "output"], "type", "tokens") \
        .where(F.col("tokens").isNotNull()).withColumn("source", F.lit("grok_code"))
    return codex.withColumn("tokens", F.col("tokens").cast("bigint")) \
        .unionByName(grok_b.withColumn("tokens", F.col("tokens").cast("bigint")))


def api_cost(basis: DataFrame, prices: DataFrame) -> DataFrame:
    """M4: list-price estimate per (source, model): sum of tokens x price
    per token over priced types; unpriced (model, type) pairs are omitted."""
    priced = J.price_join(basis, prices)
    cost = priced.groupBy("source", "model").agg(
        F.sum(F.col("tokens").cast("decimal(18,0)") * F.col("usd_per_token")).alias("_c"))
    return cost.select("source", "model", _round(F.col("_c"), 9).alias("cost_usd"))


def ai_cost(basis: DataFrame, prices: DataFrame, samples: DataFrame, now: int) -> DataFrame:
    """M5: api estimates for codex/grok plus Claude's emitted estimate."""
    api = api_cost(basis, prices).withColumn("cost_kind", F.lit("api_estimate"))
    cl = claude_latest(samples, now, "claude_code_cost_usage_USD_total")
    emitter = cl.groupBy("model").agg(F.sum("value").alias("c")).select(
        F.lit("claude_code").alias("source"), "model", _round(F.col("c"), 6).alias("cost_usd"),
        F.lit("emitter_estimate").alias("cost_kind"))
    return api.unionByName(emitter)


def ai_cost_total(basis: DataFrame, prices: DataFrame, samples: DataFrame, now: int) -> DataFrame:
    """M5, one figure per kind of estimate: tokens to ``now`` at the prices in
    effect then, and Claude's emitted estimate."""
    priced = J.price_at(basis, prices, mode="instant", at=now)
    api = priced.agg(F.sum(F.col("tokens").cast("decimal(18,0)") * F.col("usd_per_token")).alias("c")).select(
        F.lit("api_estimate").alias("cost_kind"), _round(F.col("c"), 6).alias("cost_usd"))
    cl = claude_latest(samples, now, "claude_code_cost_usage_USD_total")
    return api.unionByName(cl.agg(F.sum("value").alias("c")).select(
        F.lit("emitter_estimate").alias("cost_kind"), _round(F.col("c"), 6).alias("cost_usd")))


def billing_increase(ai_series: DataFrame, step: int = HOUR) -> DataFrame:
    """Tokens per step, source, model and priced type: reasoning is billed as
    output. Claude's tokens are not priced here."""
    inc = hourly_increase(ai_series.where(F.col("source") != "claude_code"), AI_LABELS, step)
    typ = F.when(F.col("type") == "reasoning_output", "output").otherwise(F.col("type"))
    return inc.groupBy("t", "source", "model", typ.alias("type")).agg(F.sum("value").alias("value"))


def ai_cost_over_time(ai_series: DataFrame, prices: DataFrame, samples: DataFrame, step: int = HOUR) -> DataFrame:
    """M5 over time: cost per step, source and model, each step's tokens at
    the price in effect at that step (J13), beside the increase of Claude's
    emitted estimate. Models without a price are left out."""
    priced = J.price_at(billing_increase(ai_series, step), prices)
    api = priced.groupBy("t", "source", "model").agg(
        F.sum(F.col("value").cast("decimal(18,0)") * F.col("usd_per_token")).alias("c")).select(
        "t", "source", "model", F.lit("api_estimate").alias("cost_kind"), _round(F.col("c"), 9).alias("cost_usd"))
    cost = match(samples, eq={"name": "claude_code_cost_usage_USD_total"})
    emitted = hourly_increase(cost, jobs.SAMPLE_LABELS + ["name"], step).groupBy("t", "model").agg(F.sum("value").alias("c"))
    return api.unionByName(emitted.select("t", F.lit("claude_code").alias("source"), "model", F.lit("emitter_estimate").alias("cost_kind"),
                                          _round(F.col("c")).alias("cost_usd")))


def unpriced_tokens(basis: DataFrame, prices: DataFrame) -> DataFrame:
    """M6: billing-basis tokens without a (source, model, type) price."""
    miss = basis.join(prices.select("source", "model", "type"), ["source", "model", "type"], "left_anti")
    return miss.groupBy("source", "model", "type").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def cache_hit_rate(ai: DataFrame) -> DataFrame:
    """cacheRead / (input + cacheRead + cacheCreation) per source."""
    g = ai.groupBy("source").agg(
        F.sum(F.when(F.col("type") == "cacheRead", F.col("value"))).alias("num"),
        F.sum(F.when(F.col("type").isin("input", "cacheRead", "cacheCreation"), F.col("value")))
        .alias("den"))
    g = g.where(F.col("num").isNotNull() & F.col("den").isNotNull())
    return g.select("source", _round(prom_div("num", "den")).alias("hit_rate"))


# ---- series families ---------------------------------------------------------

def codex_category_series(spark, sf_dir) -> DataFrame:
    """Codex disjoint categories on the hourly grid of the live ledger."""
    h = jobs.live_categories_table(spark, sf_dir)
    return h.select(F.lit("codex").alias("source"), F.lit(jobs.LEDGER_ENV).alias("env"), "model",
                    "type", F.lit("").alias("effort"), F.lit("").alias("agent_name"), "t",
                    F.col("value").cast("double").alias("value"))


def grok_category_series(samples: DataFrame) -> DataFrame:
    """M2 evaluated at every change point of a grok (env, model) group: the
    as-of value of each raw type is carried forward (two-level scan), then
    the categories are derived, as the recording rule does at each step."""
    g = jobs.named(samples, "grok_code_token_usage_total")
    w = _pivot(g, ["env", "model", "t"], "type", ["input", "cache_read", "output", "reasoning"])
    # one row per group and arrival batch: bounded by the time span
    win = Window.partitionBy("env", "model").orderBy("t") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.select("env", "model", "t", *[F.last(c, ignorenulls=True).over(win).alias(c)
                                        for c in ["input", "cache_read", "output", "reasoning"]])
    return grok_categories(w, ["env", "model", "t"]).select(
        "source", "env", "model", "type", F.lit("").alias("effort"), F.lit("").alias("agent_name"),
        "t", "value")


def claude_token_series(samples: DataFrame) -> DataFrame:
    c = jobs.named(samples, "claude_code_token_usage_tokens_total")
    return c.select(F.lit("claude_code").alias("source"), "env", "model", "type", "effort",
                    "agent_name", "t", "value")


def ai_token_series(spark, sf_dir, samples: DataFrame) -> DataFrame:
    return claude_token_series(samples).unionByName(codex_category_series(spark, sf_dir)) \
        .unionByName(grok_category_series(samples))


def sum_without_asof(samples: DataFrame, keys: list[str], child: list[str]) -> DataFrame:
    """``sum without(child)`` evaluated at every change point: each child
    series contributes its change since its previous sample, and a running
    sum of those changes per group gives the group's value at that time."""
    wc = Window.partitionBy(*keys, *child).orderBy("t")
    d = samples.withColumn("_d", F.col("value") - F.coalesce(F.lag("value").over(wc), F.lit(0.0)))
    per_t = d.groupBy(*keys, "t").agg(F.sum("_d").alias("_d"))
    wg = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_t.select(*keys, "t", F.sum("_d").over(wg).alias("value"))


# ---- hourly panel views ------------------------------------------------------

def hourly_increase(series: DataFrame, keys: list[str], step: int = HOUR) -> DataFrame:
    """``increase(x[step])`` evaluated at every multiple of ``step``."""
    return T.range_eval(series, step, step, "increase", keys=keys)


def capture_ratio(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """M7: Σ increase[1h] OTLP total (or 0) / Σ increase[1h] ledger total."""
    otlp = match(samples, eq={"name": "codex_turn_token_usage_sum", "token_type": "total"})
    ledger = match(samples, eq={"name": "codex_ledger_token_usage_total", "token_type": "total"})
    keys = jobs.SAMPLE_LABELS + ["name"]
    num = hourly_increase(otlp, keys, step=step).groupBy("t").agg(F.sum("value").alias("value"))
    den = hourly_increase(ledger, keys, step=step).groupBy("t").agg(F.sum("value").alias("value"))
    num0 = J.or_zero(num, den.select("t"))
    return J.v_div(num0, den, ["t"]).select("t", _round(F.col("value")).alias("ratio"))


def tokens_by(ai_series: DataFrame, dim: str) -> DataFrame:
    """M8: hourly token increase split by ``type``, ``model`` (``[1m]``
    stripped, P9) or Claude ``effort``."""
    keys = ["source", "env", "model", "type", "effort", "agent_name"]
    inc = hourly_increase(ai_series, keys)
    if dim == "model":
        inc = normalize_model(inc)
    if dim == "effort":
        inc = match(inc, eq={"source": "claude_code"}, ne={"effort": ""})
    return inc.groupBy("t", dim).agg(_round(F.sum("value")).alias("tokens"))


def effort_split(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """M9: Claude increase by non-empty effort, zero rows hidden, medium
    pinned at 0 when missing, shown only where Claude tokens exist."""
    claude = claude_token_series(samples)
    keys = ["source", "env", "model", "type", "effort", "agent_name"]
    inc = hourly_increase(claude, keys, step=step)
    gate = inc.select("t").distinct()
    by = match(inc, ne={"effort": ""}).groupBy("t", "effort").agg(F.sum("value").alias("value"))
    pos = by.where(F.col("value") > 0)
    medium = gate.select("t", F.lit("medium").alias("effort"), F.lit(0.0).alias("value"))
    out = J.v_or(pos, medium, ["t", "effort"])
    return J.v_and_on(out, gate, ["t"]).select("t", "effort", _round(F.col("value")).alias("tokens"))


def agent_tokens(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """Claude tokens per named agent and share of all Claude tokens."""
    claude = claude_token_series(samples)
    keys = ["source", "env", "model", "type", "effort", "agent_name"]
    inc = hourly_increase(claude, keys, step=step)
    total = inc.groupBy("t").agg(F.sum("value").alias("value"))
    by = match(inc, ne={"agent_name": ""}).groupBy("t", "agent_name").agg(F.sum("value").alias("value"))
    share = by.join(total.withColumnRenamed("value", "_tot"), "t", "inner")
    return share.select("t", "agent_name", _round(F.col("value")).alias("tokens"),
                        _round(prom_div("value", "_tot")).alias("share"))


def agent_cost(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """Claude emitted cost per named agent (estimate)."""
    cost = match(samples, eq={"name": "claude_code_cost_usage_USD_total"}, ne={"agent_name": ""})
    inc = hourly_increase(cost, jobs.SAMPLE_LABELS + ["name"], step=step)
    return inc.groupBy("t", "agent_name").agg(_round(F.sum("value")).alias("cost_usd"))


def session_starts(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """Claude session starts, excluding agents_view starts."""
    s = match(samples, eq={"name": "claude_code_session_count_total"}, ne={"start_type": "agents_view"})
    inc = hourly_increase(s, jobs.SAMPLE_LABELS + ["name"], step=step)
    return inc.groupBy("t").agg(_round(F.sum("value")).alias("sessions"))


def thread_series(samples: DataFrame) -> DataFrame:
    """ai_thread_count_total = sum without(is_git) of codex thread starts."""
    th = jobs.named(samples, "codex_thread_started_total").select("env", "is_git", "t", "value")
    return sum_without_asof(th, ["env"], ["is_git"])


def thread_starts(samples: DataFrame, step: int = HOUR) -> DataFrame:
    """Codex thread starts (never merged with sessions)."""
    inc = hourly_increase(thread_series(samples), ["env"], step=step)
    return inc.groupBy("t").agg(_round(F.sum("value")).alias("threads"))


def tokens_per_work_unit(spark, sf_dir, samples: DataFrame) -> DataFrame:
    """Σ tokens / clamp_min(Σ starts, 1) per source and hour."""
    ai = ai_token_series(spark, sf_dir, samples)
    keys = ["source", "env", "model", "type", "effort", "agent_name"]
    tok = hourly_increase(ai, keys).groupBy("t", "source").agg(F.sum("value").alias("value"))
    s = match(samples, eq={"name": "claude_code_session_count_total"}, ne={"start_type": "agents_view"})
    sess = hourly_increase(s, jobs.SAMPLE_LABELS + ["name"]).groupBy("t").agg(F.sum("value").alias("value")) \
        .withColumn("source", F.lit("claude_code"))
    thr = hourly_increase(thread_series(samples), ["env"]).groupBy("t").agg(F.sum("value").alias("value")) \
        .withColumn("source", F.lit("codex"))
    out = J.v_div_floor(tok, sess.unionByName(thr), ["t", "source"])
    return out.select("t", "source", _round(F.col("value")).alias("tokens_per_unit"))


def productivity(samples: DataFrame) -> DataFrame:
    """Hourly increase of commits (codex via T12), pull requests,
    lines changed, edit decisions and active seconds."""
    keys = jobs.SAMPLE_LABELS + ["name"]

    def inc(name, split):
        s = jobs.named(samples, name)
        i = hourly_increase(s, keys)
        sp = F.col(split) if split else F.lit("")
        return i.groupBy("t", sp.alias("split")).agg(F.sum("value").alias("value"))

    parts = [
        inc("claude_code_commit_count_total", None).withColumn("metric", F.lit("commits"))
        .withColumn("split", F.lit("claude_code")),
        T.first_batch_growth(jobs.named(samples, "codex_git_commit_count_total"), HOUR, HOUR)
        .select("t", F.lit("codex").alias("split"), "value", F.lit("commits").alias("metric")),
        inc("claude_code_pull_request_count_total", None).withColumn("metric", F.lit("pull_requests")),
        inc("claude_code_lines_of_code_count_total", "type").withColumn("metric", F.lit("lines_of_code")),
        inc("claude_code_code_edit_tool_decision_total", "decision")
        .withColumn("metric", F.lit("edit_decisions")),
        inc("claude_code_active_time_seconds_total", "type").withColumn("metric", F.lit("active_seconds")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("t", "metric", "split", _round(F.col("value")).alias("value"))


def splice_check(history: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Per history label set, the history must end before the first
    live sample and the label set must exist live."""
    h = history.groupBy(*keys).agg(F.max("t").alias("history_end"))
    lv = live.groupBy(*keys).agg(F.min("t").alias("live_start"))
    j = h.join(lv, keys, "left")
    return j.select(*keys, "history_end", "live_start",
                    F.coalesce(F.col("history_end") < F.col("live_start"), F.lit(False)).alias("ok"))
