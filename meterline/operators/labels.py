"""Projections, filters and label algebra."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import anchored
from ..session import bounded_broadcast

# The privacy allowlist. Data-point attribute keys kept by the
# collector (everything else is dropped, fail-closed), and resource keys.
POINT_KEY_PATTERN = r"^(agent[.]name|decision|effort|is_git|model|start_type|token_type|type)$"
RESOURCE_KEY_PATTERN = r"^env$"
# Allowlisted point keys as exposed label columns ("agent.name" -> "agent_name").
LABEL_KEYS = [
    ("agent.name", "agent_name"),
    ("decision", "decision"),
    ("effort", "effort"),
    ("is_git", "is_git"),
    ("model", "model"),
    ("start_type", "start_type"),
    ("token_type", "token_type"),
    ("type", "type"),
]
LABELS = [c for _, c in LABEL_KEYS]

# The metric contract. Only these families, and only with
# delta temporality (1), pass the collector.
CONTRACT_PATTERN = (
    r"^(claude_code[.](token[.]usage|cost[.]usage|commit[.]count|pull_request[.]count"
    r"|lines_of_code[.]count|code_edit_tool[.]decision|active_time[.]total|session[.]count)"
    r"|codex[.](turn[.]token_usage|thread[.]started)|grok_code[.]token[.]usage)$"
)
DELTA = 1

# OTLP metric name -> exposed series name (histograms get
# _sum / _count / _bucket suffixes on the base name).
SERIES_NAMES = [
    ("claude_code.token.usage", "claude_code_token_usage_tokens_total"),
    ("claude_code.cost.usage", "claude_code_cost_usage_USD_total"),
    ("claude_code.commit.count", "claude_code_commit_count_total"),
    ("claude_code.pull_request.count", "claude_code_pull_request_count_total"),
    ("claude_code.lines_of_code.count", "claude_code_lines_of_code_count_total"),
    ("claude_code.code_edit_tool.decision", "claude_code_code_edit_tool_decision_total"),
    ("claude_code.active_time.total", "claude_code_active_time_seconds_total"),
    ("claude_code.session.count", "claude_code_session_count_total"),
    ("codex.turn.token_usage", "codex_turn_token_usage"),
    ("codex.thread.started", "codex_thread_started_total"),
    ("grok_code.token.usage", "grok_code_token_usage_total"),
    ("codex.git.commit.count", "codex_git_commit_count_total"),
]


# The recording rules that rename a series and set labels, as
# (input series, recorded name, labels).
RENAME_RULES = [
    ("claude_code_token_usage_tokens_total", "ai_token_usage_tokens_total", {"source": "claude_code"}),
    ("claude_code_cost_usage_USD_total", "ai_cost_usage_usd_total", {"source": "claude_code", "cost_kind": "emitter_estimate"}),
    ("claude_code_commit_count_total", "ai_commit_count_total", {"source": "claude_code"}),
    ("codex_git_commit_count_total", "ai_commit_count_total", {"source": "codex"}),
    ("claude_code_pull_request_count_total", "ai_pull_request_count_total", {"source": "claude_code"}),
    ("claude_code_lines_of_code_count_total", "ai_lines_of_code_count_total", {"source": "claude_code"}),
    ("claude_code_code_edit_tool_decision_total", "ai_code_edit_tool_decision_total", {"source": "claude_code"}),
    ("claude_code_active_time_seconds_total", "ai_active_time_seconds_total", {"source": "claude_code"}),
    ("claude_code_session_count_total", "ai_session_count_total", {"source": "claude_code"}),
]


def upsert_env(df: DataFrame, env: str) -> DataFrame:
    """The configured environment overwrites resource ``env``."""
    return df.withColumn("resource", F.map_concat(
        F.map_filter("resource", lambda k, v: k != "env"),
        F.create_map(F.lit("env"), F.lit(env))))


def keep_labels(df: DataFrame) -> DataFrame:
    """Privacy allowlist on resource and point attributes, and the
    allowlisted keys as typed label columns ('' when absent). The labels look
    their keys up in the maps as they came, so plans that need no map filter none."""
    res = F.map_filter("resource", lambda k, v: k == "env")
    att = F.map_filter("attrs", lambda k, v: k.isin([key for key, _ in LABEL_KEYS]))
    labels = {col: F.coalesce(F.col("attrs")[key], F.lit("")) for key, col in LABEL_KEYS}
    env = F.coalesce(F.col("resource")["env"], F.lit(""))
    return df.withColumns({"resource": res, "attrs": att, "env": env, **labels})


def contract_filter(df: DataFrame) -> DataFrame:
    """Drop unknown metric families and non-delta temporality (a NULL
    temporality is dropped too)."""
    return df.where(F.col("metric").rlike(CONTRACT_PATTERN) &
                    F.coalesce(F.col("temporality") == DELTA, F.lit(False)))


def normalize_scope(df: DataFrame) -> DataFrame:
    """Scope name/version/attributes collapse to constants."""
    return df.withColumn("scope_name", F.lit("meterline")) \
        .withColumn("scope_version", F.lit("")) \
        .withColumn("scope_attrs", F.create_map().cast("map<string,string>"))


def series_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERIES_NAMES, "metric string, series string")


def series_name(df: DataFrame, part: str | None = None) -> DataFrame:
    """P5: OTLP metric name -> series name through a 12-row broadcast map.
    ``part`` is the histogram component ('sum', 'count', 'bucket')."""
    m = F.broadcast(series_map(df.sparkSession))
    out = df.join(m, "metric", "inner")
    if part:
        out = out.withColumn("series", F.concat(F.col("series"), F.lit("_" + part)))
    return out.withColumnRenamed("series", "name")


def strip_log_content(df: DataFrame) -> DataFrame:
    """A log record keeps only ``env`` and its arrival time."""
    return df.select(F.coalesce(F.col("resource")["env"], F.lit("")).alias("env"), "arrival_ts")


def match(df: DataFrame, eq: Mapping[str, str] | None = None,
          ne: Mapping[str, str] | None = None,
          re: Mapping[str, str | list] | None = None,
          nre: Mapping[str, str | list] | None = None) -> DataFrame:
    """Label matchers ``= != =~ !~``; regexes are fully anchored; an
    absent label equals ''. Several matchers on one label are ANDed (pass a
    list for repeated regex matchers)."""
    cond = F.lit(True)

    def lab(c):
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")

    for c, v in (eq or {}).items():
        cond = cond & (lab(c) == v)
    for c, v in (ne or {}).items():
        cond = cond & (lab(c) != v)
    for c, vs in (re or {}).items():
        for v in ([vs] if isinstance(vs, str) else vs):
            cond = cond & anchored(lab(c), v)
    for c, vs in (nre or {}).items():
        for v in ([vs] if isinstance(vs, str) else vs):
            cond = cond & ~anchored(lab(c), v)
    return df.where(cond)


def relabel(df: DataFrame, to: str, set_labels: Mapping[str, str] | None = None) -> DataFrame:
    """Recording-rule rename; rule labels override input labels."""
    out = df.withColumn("name", F.lit(to))
    for k, v in (set_labels or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def rename_rules(spark: SparkSession, rules=RENAME_RULES) -> DataFrame:
    """The rules as a table (name, recorded, labels)."""
    return spark.createDataFrame(rules, "name string, recorded string, labels map<string,string>")


def record(samples: DataFrame, rules: DataFrame, labels: list[str]) -> DataFrame:
    """P8 for a table of rules in one pass: each sample once per rule on its
    series (``name``), under the recorded name; a rule's label overrides the
    sample's. ``labels`` are the label columns of the result, '' where neither
    has one; the samples' other columns stay. Rules are data: adding one adds
    no scan and no branch to the plan."""
    known = set(samples.columns)
    merged = [F.coalesce(F.col("_set")[c], F.col(c) if c in known else F.lit(""), F.lit("")).alias(c) for c in labels]
    rest = [c for c in samples.columns if c not in labels and c != "name"]
    table = bounded_broadcast(rules.select("name", F.col("recorded").alias("_recorded"), F.col("labels").alias("_set")))
    return samples.join(table, "name").select(F.col("_recorded").alias("name"), *merged, *rest)


def normalize_model(df: DataFrame, col: str = "model") -> DataFrame:
    """Strip a trailing ``[1m]`` context marker (token views only)."""
    return df.withColumn(col, F.regexp_replace(col, r"\[1m\]$", ""))


def label_replace(df: DataFrame, dst: str, repl: str, src: str, regex: str) -> DataFrame:
    """P10: ``label_replace``: when ``src`` fully matches ``regex``, ``dst``
    becomes ``repl`` with ``$n`` groups; otherwise the row is unchanged."""
    srcv = F.coalesce(F.col(src), F.lit("")) if src in df.columns else F.lit("")
    cur = F.col(dst) if dst in df.columns else F.lit("")
    new = F.regexp_replace(srcv, f"^(?:{regex})$", repl)
    return df.withColumn(dst, F.when(anchored(srcv, regex), new).otherwise(cur))


def parse_cutoff(end: str) -> dt.datetime:
    """P12 driver-side check: ISO time, naive = UTC, must be hour-aligned."""
    utc = dt.timezone.utc
    at = dt.datetime.fromisoformat(end)
    at = at.astimezone(utc) if at.tzinfo else at.replace(tzinfo=utc)
    if (at.minute, at.second, at.microsecond) != (0, 0, 0):
        raise ValueError(f"cutoff must be hour-aligned, got {end}")
    return at


def compare(df: DataFrame, op: str, x: float, value: str = "value") -> DataFrame:
    """PromQL filtering comparison (drops rows, keeps values)."""
    v = F.col(value)
    cond = {">": v > x, ">=": v >= x, "<": v < x, "<=": v <= x,
            "==": v == x, "!=": v != x}[op]
    return df.where(cond)
