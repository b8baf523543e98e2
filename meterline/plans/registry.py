"""Registered queries: one per operator of the inventory, each reading the
driver tables through :mod:`meterline.plans.adapters`.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
computed columns carry the same aliases as the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import commits as C
from ..operators import labels as P
from ..operators import quality as Q
from ..operators import series as T
from ..operators import vector as J
from ..operators.dedup import scan_stats
from ..sinks import text as K
from ..sources import ledger as L
from ..sources.prices import price_rows
from . import adapters, jobs, views

HOUR = 3600
DAY = 86400
TOKEN_KEYS = ["source", "env", "model", "type", "effort", "agent_name"]

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REG[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REG)


def _r(c, d=6):
    return F.round(F.col(c).cast("double"), d)


def _samples(spark, sf):
    return jobs.samples_table(spark, sf)


def _labels_out(df):
    return df.select("name", *jobs.SAMPLE_LABELS, "t", _r("value").alias("value"))


# ---- ledger lane --------------------------------------------------------------

@query("usage_records")
def q_usage_records(spark, sf):
    r = jobs.records_table(spark, sf).where(~F.col("is_error"))
    return r.select("path", "ts_raw", "model", *L.TOKEN_TYPES)


@query("dedup_replays")
def q_dedup_replays(spark, sf):
    k = jobs.kept_table(spark, sf)
    return k.select("path", "ts_raw", "model", F.col("copies").cast("bigint").alias("copies"),
                    *L.TOKEN_TYPES)


@query("scan_stats")
def q_scan_stats(spark, sf):
    files = L.discover(jobs.lines_table(spark, sf)).select("path").distinct()
    return scan_stats(jobs.records_table(spark, sf), jobs.kept_table(spark, sf), files)


@query("ledger_totals")
def q_ledger_totals(spark, sf):
    return A.ledger_totals(jobs.kept_table(spark, sf))


@query("turn_records")
def q_turn_records(spark, sf):
    return A.turn_records(jobs.kept_table(spark, sf))


@query("hourly_usage")
def q_hourly_usage(spark, sf):
    return jobs.ledger_hourly(spark, sf)


@query("hourly_grid")
def q_hourly_grid(spark, sf):
    return jobs.ledger_grid(spark, sf)


@query("history_summary")
def q_history_summary(spark, sf):
    return A.history_summary(jobs.ledger_hourly(spark, sf), jobs.ledger_grid(spark, sf),
                             jobs.end_seconds())


@query("openmetrics_history")
def q_openmetrics_history(spark, sf):
    return K.openmetrics_history(jobs.history_table(spark, sf), env=jobs.LEDGER_ENV)


@query("exposition_text")
def q_exposition_text(spark, sf):
    kept = jobs.kept_table(spark, sf)
    shrunk = q_corpus_shrunk(spark, sf).agg(F.coalesce(F.max("shrunk"), F.lit(0))).scalar()
    stats = q_scan_stats(spark, sf).withColumn("corpus_shrunk", shrunk)
    return K.exposition_text(A.ledger_totals(kept), A.turn_records(kept), jobs.LEDGER_ENV, stats)


@query("corpus_shrunk")
def q_corpus_shrunk(spark, sf):
    snapshots, scans = daily_snapshots(spark, sf)
    return T.corpus_shrunk(snapshots, scans)


def daily_snapshots(spark, sf):
    """Ledger scans at the end of each day of the data: totals over kept
    records up to that day; files of users with user_id % 13 = 0 are deleted
    from the 20th day on, so later scans shrink. Returns (snapshots, scans)."""
    kept = A.with_parsed_ts(jobs.kept_table(spark, sf)).where(F.col("ts").isNotNull())
    user = F.regexp_extract("path", r"u(\d+)", 1).cast("bigint")
    kept = kept.withColumn("_day", F.floor(A.epoch_seconds(F.col("ts")) / DAY)).withColumn("_gone", (user % 13 == 0))
    days = kept.agg(F.min("_day").alias("a"), F.max("_day").alias("b"))
    scans = days.where("a is not null").select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("b - a + 1"))).alias("scan"))
    daily = A.ledger_totals(kept, by=["_day", "_gone", "model"])
    daily = daily.withColumn("_a", days.select("a").scalar()).withColumn("_b", days.select("b").scalar())
    # a day's usage is in every later scan, until its file is gone; a daily
    # row fans out to one row per later day (an explode, no join)
    first = F.col("_day") - F.col("_a") + 1
    last = F.col("_b") - F.col("_a") + 1
    last = F.when(F.col("_gone"), F.least(F.lit(19), last)).otherwise(last)
    at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    j = daily.select("model", "token_type", "value", F.explode(at).alias("scan"))
    return j.groupBy("scan", "model", "token_type").agg(F.sum("value").cast("bigint").alias("value")), scans


@query("splice_check")
def q_splice_check(spark, sf):
    """The backfill against what the live ledger shows from the cutoff on."""
    live = jobs.live_categories_table(spark, sf).where(F.col("t") >= jobs.end_seconds())
    return views.splice_check(jobs.history_table(spark, sf), live, ["model", "type"])


# ---- cost -------------------------------------------------------------------------

def _totals(spark, sf):
    return A.ledger_totals(jobs.kept_table(spark, sf))


def _basis(spark, sf):
    grok = jobs.family(spark, sf, "grok_code.token.usage")
    return views.billing_basis(_totals(spark, sf), views.grok_latest(grok, jobs.last_sample(spark, sf)))


@query("disjoint_codex")
def q_disjoint_codex(spark, sf):
    return views.disjoint_codex(_totals(spark, sf)).select("source", "model", "type", _r("value").alias("value"))


@query("disjoint_grok")
def q_disjoint_grok(spark, sf):
    grok = jobs.family(spark, sf, "grok_code.token.usage")
    g = views.disjoint_grok(views.grok_latest(grok, jobs.last_sample(spark, sf)))
    return g.select("source", "env", "model", "type", _r("value").alias("value"))


@query("ai_tokens")
def q_ai_tokens(spark, sf):
    ai = views.ai_tokens(_samples(spark, sf), _totals(spark, sf), jobs.last_sample(spark, sf))
    return ai.select(*TOKEN_KEYS, _r("value").alias("value"))


@query("api_cost")
def q_api_cost(spark, sf):
    return views.api_cost(_basis(spark, sf), price_rows(spark))


@query("ai_cost")
def q_ai_cost(spark, sf):
    emitted = jobs.family(spark, sf, "claude_code.cost.usage")
    return views.ai_cost(_basis(spark, sf), price_rows(spark), emitted, jobs.last_sample(spark, sf))


@query("unpriced_tokens")
def q_unpriced_tokens(spark, sf):
    return views.unpriced_tokens(_basis(spark, sf), price_rows(spark))


@query("cache_hit_rate")
def q_cache_hit_rate(spark, sf):
    return views.cache_hit_rate(views.ai_tokens(_samples(spark, sf), _totals(spark, sf), jobs.last_sample(spark, sf)))


@query("price_join")
def q_price_join(spark, sf):
    j = J.price_join(_basis(spark, sf), price_rows(spark))
    return j.select("source", "model", "type", "tokens",
                    F.round((F.col("tokens").cast("decimal(18,0)") * F.col("usd_per_token")).cast("double"), 9)
                    .alias("cost_usd"))


def price_history(spark):
    """Prices with validity ranges splitting January 2024 (own fixture):
    the manifest rate from the 16th on, 80 % of it before."""
    p = price_rows(spark).where(F.col("source") == "codex")
    early = p.select("source", "model", "type",
                     (F.col("usd_per_token") * F.lit(Decimal("0.8"))).cast("decimal(18,12)")
                     .alias("usd_per_token"),
                     F.lit(None).cast("date").alias("effective_from"),
                     F.to_date(F.lit("2024-01-15")).alias("effective_to"))
    late = p.select("source", "model", "type", "usd_per_token",
                    F.to_date(F.lit("2024-01-16")).alias("effective_from"),
                    F.lit(None).cast("date").alias("effective_to"))
    return early.unionByName(late)


def all_price_history(spark):
    """The codex price history and the other sources' open prices."""
    codex = price_history(spark)
    none = F.lit(None).cast("date")
    other = price_rows(spark).where(F.col("source") != "codex").select("source", "model", "type", "usd_per_token")
    return codex.unionByName(other.withColumn("effective_from", none).withColumn("effective_to", none))


@query("ai_cost_over_time")
def q_ai_cost_over_time(spark, sf):
    s = _samples(spark, sf)
    return views.ai_cost_over_time(views.ai_token_series(spark, sf, s), all_price_history(spark), s)


@query("ai_cost_total")
def q_ai_cost_total(spark, sf):
    emitted = jobs.family(spark, sf, "claude_code.cost.usage")
    return views.ai_cost_total(_basis(spark, sf), all_price_history(spark), emitted, jobs.last_sample(spark, sf))


@query("price_at")
def q_price_at(spark, sf):
    """Hourly codex category growth priced at the rate in effect, to the
    end of the data."""
    h = jobs.live_categories_table(spark, sf).withColumnRenamed("value", "cum")
    src = h.select(F.lit("codex").alias("source"), "model", "type", "t",
                   F.col("cum").cast("double").alias("value"))
    inc = T.range_eval(src.where(F.col("type") != "reasoning_output"), HOUR, HOUR, "increase",
                       keys=["source", "model", "type"])
    priced = J.price_at(inc, price_history(spark))
    return priced.groupBy("t", "model").agg(
        F.round(F.sum(F.col("value").cast("decimal(18,0)") * F.col("usd_per_token")).cast("double"), 9)
        .alias("cost_usd"))


# ---- collector lane ------------------------------------------------------------

def _points(spark, sf):
    return jobs.points_table(spark, sf)


@query("keep_labels")
def q_keep_labels(spark, sf):
    p = P.keep_labels(_points(spark, sf))
    return p.select("event_id", "metric", "env", *P.LABELS,
                    F.size("attrs").alias("n_attrs"), F.size("resource").alias("n_resource"))


@query("contract_filter")
def q_contract_filter(spark, sf):
    p = P.contract_filter(P.keep_labels(_points(spark, sf)))
    return p.groupBy("metric", "temporality").agg(F.count("*").cast("bigint").alias("points"))


@query("upsert_env")
def q_upsert_env(spark, sf):
    p = P.keep_labels(P.upsert_env(_points(spark, sf), "prod"))
    return p.groupBy("env").agg(F.count("*").cast("bigint").alias("points"))


@query("compact_deltas")
def q_compact_deltas(spark, sf):
    d = jobs.sum_deltas(_points(spark, sf))
    return d.select("batch_t", "metric", "env", *P.LABELS, _r("value").alias("value"))


@query("merge_histograms")
def q_merge_histograms(spark, sf):
    h = jobs.hist_deltas(_points(spark, sf))
    return h.select("batch_t", "metric", "env", "model", "token_type",
                    F.col("h_count").cast("bigint").alias("h_count"), _r("h_sum").alias("h_sum"),
                    *[F.element_at("bucket_counts", i + 1).cast("bigint").alias(f"b{i}") for i in range(3)])


@query("bucket_series")
def q_bucket_series(spark, sf):
    h = jobs.hist_deltas(_points(spark, sf))
    b = A.bucket_series(h, keep=["batch_t", "env", "token_type"])
    return b.select("batch_t", "env", "token_type", "le", F.col("count").cast("bigint").alias("count"))


@query("delta_to_cumulative")
def q_delta_to_cumulative(spark, sf):
    return _labels_out(jobs.otlp_samples(_points(spark, sf)))


@query("delta_to_cumulative_stream")
def q_delta_to_cumulative_stream(spark, sf):
    """T2 on a stream: final per-stream totals of the plain streaming form."""
    t = jobs.stream_totals_table(spark, sf)
    return t.select("metric", "part", "env", *P.LABELS, "le", _r("value").alias("value"))


@query("cumulative_stream_restart")
def q_cumulative_stream_restart(spark, sf):
    """T2 on a stream with stale restart: every cumulative sample."""
    return _labels_out(jobs.as_samples(jobs.restart_stream_table(spark, sf)))


@query("series_name")
def q_series_name(spark, sf):
    s = _samples(spark, sf)
    return s.groupBy("name").agg(F.count("*").cast("bigint").alias("samples"))


@query("count_events")
def q_count_events(spark, sf):
    log = adapters.commit_log(spark, sf).withColumn("arrival_ts", F.col("time_ns"))
    c = A.count_events(P.strip_log_content(log), adapters.arrival_minute(F.col("arrival_ts")))
    return c.select("batch_t", "env", "metric", F.col("value").cast("bigint").alias("value"))


@query("identity_leaks")
def q_identity_leaks(spark, sf):
    return Q.identity_leaks(_points(spark, sf))


@query("identity_values")
def q_identity_values(spark, sf):
    """Q5: users' identity values in the raw points (what P2 must remove) and
    in the labels of the exposed series (there must be none)."""
    secrets = adapters.identities(spark, sf)
    raw = Q.identity_values(_points(spark, sf), secrets, maps=["resource", "attrs"])
    return raw.unionByName(Q.identity_values(_samples(spark, sf), secrets, labels=jobs.SAMPLE_LABELS))


# ---- counters and label algebra -------------------------------------------------

@query("increase")
def q_increase(spark, sf):
    return _labels_out(T.range_eval(_samples(spark, sf), HOUR, HOUR, "increase"))


@query("rate_per_hour")
def q_rate_per_hour(spark, sf):
    s = jobs.named(_samples(spark, sf), "claude_code_token_usage_tokens_total")
    return _labels_out(T.rate_per_hour(s, 900))


@query("over_time")
def q_over_time(spark, sf):
    s = _samples(spark, sf)
    keys = ["name", *jobs.SAMPLE_LABELS]
    both = T.extremes_over_time(s, HOUR, 4 * HOUR, keys)
    return both.select(*keys, "t", _r("min_value").alias("min_value"), _r("max_value").alias("max_value"))


@query("instant")
def q_instant(spark, sf):
    return _labels_out(T.instant_range(_samples(spark, sf), HOUR))


@query("offset")
def q_offset(spark, sf):
    return _labels_out(T.instant_range(_samples(spark, sf), HOUR, offset=HOUR))


@query("expire")
def q_expire(spark, sf):
    return _labels_out(T.expire(_samples(spark, sf), jobs.last_sample(spark, sf) - 2 * DAY))


@query("range_eval")
def q_range_eval(spark, sf):
    r = T.range_eval(_samples(spark, sf), HOUR, 4 * HOUR, "increase")
    r = r.groupBy("name", "t").agg(F.sum("value").alias("value"))
    return r.select("name", "t", _r("value").alias("value"))


@query("first_batch_growth")
def q_first_batch_growth(spark, sf):
    c = jobs.named(_samples(spark, sf), "codex_git_commit_count_total")
    return T.first_batch_growth(c, HOUR, HOUR).select("t", _r("value").alias("value"))


def _latest(spark, sf):
    return T.expire(_samples(spark, sf), jobs.last_sample(spark, sf))


@query("sum_without")
def q_sum_without(spark, sf):
    s = _latest(spark, sf).drop("t")
    out = A.sum_without(s, ["token_type", "type", "le"])
    return out.select(*[c for c in out.columns if c != "value"], _r("value").alias("value"))


@query("sum_by")
def q_sum_by(spark, sf):
    return A.sum_by(_latest(spark, sf), ["name", "env"]).select("name", "env", _r("value").alias("value"))


@query("count_by")
def q_count_by(spark, sf):
    return A.count_by(_latest(spark, sf), ["name"])


@query("match")
def q_match(spark, sf):
    s = P.match(_samples(spark, sf), eq={"name": "claude_code_token_usage_tokens_total"},
                ne={"effort": ""}, re={"model": "claude-opus.*"}, nre={"type": "cache.*"})
    return _labels_out(s)


@query("relabel")
def q_relabel(spark, sf):
    s = jobs.named(_samples(spark, sf), "claude_code_session_count_total")
    r = P.relabel(s, "ai_session_count_total", {"source": "claude_code"})
    return r.groupBy("name", "source", "start_type").agg(
        F.count("*").cast("bigint").alias("samples"), F.round(F.max("value"), 6).alias("max_value"))


@query("recorded_series")
def q_recorded_series(spark, sf):
    """Every rename rule over one scan of the samples."""
    r = P.record(_samples(spark, sf), P.rename_rules(spark), ["source", "cost_kind", *jobs.SAMPLE_LABELS])
    return r.select("name", "source", "cost_kind", *jobs.SAMPLE_LABELS, "t", _r("value").alias("value"))


@query("normalize_model")
def q_normalize_model(spark, sf):
    s = P.normalize_model(_latest(spark, sf))
    return s.groupBy("name", "model").agg(F.round(F.sum("value"), 6).alias("value"))


@query("label_replace")
def q_label_replace(spark, sf):
    s = P.label_replace(_latest(spark, sf), "family", "$1", "model", "([a-z]+)-.*")
    return s.groupBy("family").agg(F.count("*").cast("bigint").alias("series"))


@query("compare")
def q_compare(spark, sf):
    inc = T.range_eval(_samples(spark, sf), HOUR, HOUR, "increase")
    return _labels_out(P.compare(inc, ">", 1000.0))


# ---- vector matching ---------------------------------------------------------------

def _claude_hourly(spark, sf, typ):
    s = P.match(_samples(spark, sf), eq={"name": "claude_code_token_usage_tokens_total", "type": typ})
    inc = T.range_eval(s, HOUR, HOUR, "increase")
    return inc.groupBy("t", "model").agg(F.sum("value").alias("value"))


@query("v_sub")
def q_v_sub(spark, sf):
    t = _totals(spark, sf)
    a = t.where(F.col("token_type") == "input").select("model", "value")
    b = t.where(F.col("token_type") == "cache_write_input").select("model", "value")
    return J.v_sub(a, b, ["model"]).select("model", F.col("value").cast("bigint").alias("value"))


@query("v_sub_or_zero")
def q_v_sub_or_zero(spark, sf):
    t = _totals(spark, sf)
    a = t.where(F.col("token_type") == "output").select("model", "value")
    b = t.where(F.col("token_type") == "reasoning_output").select("model", "value")
    return J.v_sub_or_zero(a, b, ["model"]).select("model", _r("value").alias("value"))


@query("v_unless")
def q_v_unless(spark, sf):
    s = _samples(spark, sf)
    keys = ["name", *jobs.SAMPLE_LABELS]
    late = T.expire(s, jobs.last_sample(spark, sf)).drop("t")
    early = T.expire(s, jobs.last_sample(spark, sf) - 7 * DAY).drop("t")
    return J.v_unless(late, early, keys).select(*keys, _r("value").alias("value"))


@query("v_and_on")
def q_v_and_on(spark, sf):
    a = _claude_hourly(spark, sf, "output")
    c = jobs.named(_samples(spark, sf), "codex_git_commit_count_total")
    gate = T.range_eval(c, HOUR, HOUR, "count_over_time").select("t")
    return J.v_and_on(a, gate, ["t"]).select("t", "model", _r("value").alias("value"))


@query("v_or")
def q_v_or(spark, sf):
    a = _claude_hourly(spark, sf, "output")
    b = _claude_hourly(spark, sf, "input")
    return J.v_or(a, b, ["t", "model"]).select("t", "model", _r("value").alias("value"))


@query("or_zero")
def q_or_zero(spark, sf):
    s = _samples(spark, sf)
    otlp = P.match(s, eq={"name": "codex_turn_token_usage_sum", "token_type": "total"})
    num = T.range_eval(otlp, HOUR, HOUR, "increase").groupBy("t").agg(F.sum("value").alias("value"))
    grid = jobs.live_categories_table(spark, sf).select("t").distinct()
    return J.or_zero(num, grid).select("t", _r("value").alias("value"))


@query("v_div")
def q_v_div(spark, sf):
    a = _claude_hourly(spark, sf, "output")
    b = _claude_hourly(spark, sf, "cacheCreation")
    return J.v_div(a, b, ["t", "model"]).select("t", "model", _r("value").alias("ratio"))


@query("v_div_floor")
def q_v_div_floor(spark, sf):
    a = _claude_hourly(spark, sf, "output")
    b = _claude_hourly(spark, sf, "cacheCreation")
    return J.v_div_floor(a, b, ["t", "model"]).select("t", "model", _r("value").alias("ratio"))


@query("union_sources")
def q_union_sources(spark, sf):
    ai = views.ai_token_series(spark, sf, _samples(spark, sf))
    return ai.groupBy("source", "type").agg(F.count("*").cast("bigint").alias("samples"))


# ---- panels ------------------------------------------------------------------------

@query("capture_ratio")
def q_capture_ratio(spark, sf):
    return views.capture_ratio(_samples(spark, sf))


@query("tokens_by_type")
def q_tokens_by_type(spark, sf):
    return views.tokens_by(views.ai_token_series(spark, sf, _samples(spark, sf)), "type")


@query("tokens_by_model")
def q_tokens_by_model(spark, sf):
    return views.tokens_by(views.ai_token_series(spark, sf, _samples(spark, sf)), "model")


@query("tokens_by_effort")
def q_tokens_by_effort(spark, sf):
    return views.tokens_by(views.claude_token_series(_samples(spark, sf)), "effort")


@query("effort_split")
def q_effort_split(spark, sf):
    return views.effort_split(_samples(spark, sf))


@query("agent_tokens")
def q_agent_tokens(spark, sf):
    return views.agent_tokens(_samples(spark, sf))


@query("agent_cost")
def q_agent_cost(spark, sf):
    return views.agent_cost(_samples(spark, sf))


@query("session_starts")
def q_session_starts(spark, sf):
    return views.session_starts(_samples(spark, sf))


@query("thread_starts")
def q_thread_starts(spark, sf):
    return views.thread_starts(_samples(spark, sf))


@query("tokens_per_work_unit")
def q_tokens_per_work_unit(spark, sf):
    return views.tokens_per_work_unit(spark, sf, _samples(spark, sf))


@query("productivity")
def q_productivity(spark, sf):
    return views.productivity(_samples(spark, sf))


# ---- commit lane ------------------------------------------------------------------

def _paired(spark, sf):
    return C.pair_tool_calls(adapters.tool_calls(spark, sf))


@query("pair_tool_calls")
def q_pair_tool_calls(spark, sf):
    return _paired(spark, sf).select("invocation_id", "repo", "started", "ended")


@query("attribute_commits")
def q_attribute_commits(spark, sf):
    return C.attribute_commits(_paired(spark, sf), adapters.commits(spark, sf))


COMMIT_KEY = b"meterline-test-key"


@query("append_commit_events")
def q_append_commit_events(spark, sf):
    """K3 with D4's ids: the commits of the first half of the time span are
    already logged; the attributed commits append in order of their time."""
    from ..operators.dedup import commit_dedupe_ids
    ids = lambda df: commit_dedupe_ids(df, COMMIT_KEY)
    made = adapters.commits(spark, sf)
    half = made.agg(F.floor((F.min("committed_at") + F.max("committed_at")) / 2)).scalar()
    att = C.attribute_commits(_paired(spark, sf), made)
    new = ids(att).select("dedupe_id", F.col("committed_at").alias("order"))
    return C.append_commit_events(ids(made.where(F.col("committed_at") < half)).select("dedupe_id"), new)


@query("tail_commit_events")
def q_tail_commit_events(spark, sf):
    """S5 tailed: the valid events of the growing commit log."""
    return jobs.tailed_events_table(spark, sf).select("dedupe_id", "event")


@query("commit_dedupe_ids")
def q_commit_dedupe_ids(spark, sf):
    from ..operators.dedup import commit_dedupe_ids
    return commit_dedupe_ids(adapters.commits(spark, sf), COMMIT_KEY).select("repo", "sha", "dedupe_id")


# ---- quality -------------------------------------------------------------------------

@query("leak_scan")
def q_leak_scan(spark, sf):
    from ..session import table
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return Q.leak_scan(docs, include_allowed=True)

