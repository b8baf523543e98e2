"""Driver tables -> domain tables.

The driver ships TPC-H-like tables plus an ``events`` stream table and a
``documents`` corpus. These adapters derive, with integer arithmetic only
(so results hash identically in any engine), the inputs the telemetry jobs
consume: session-ledger lines, OTLP delta points, tool-call hook rows,
commits and commit-log records. Every derived row comes from a driver row,
so the work grows with the tables. The matching DuckDB text lives in
:mod:`meterline.plans.oracle`.

``k`` is ``props.$.k`` (0..99) and ``amt`` = floor(value * 100).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, table

# Fixed adapter rules (our own; mirrored in the oracle SQL).
MODEL_BY_EVENT = [("click", "gpt-5.6-sol"), ("purchase", "gpt-5.5"), ("view", "gpt-5.4-mini"),
                  ("signup", "grok-4.6"), ("error", "unlisted")]
COPY_MODEL_BY_EVENT = [("click", "gpt-5.5"), ("purchase", "gpt-5.4-mini"),
                       ("view", "gpt-5.6-sol"), ("signup", "unlisted"), ("error", "grok-4.6")]
CLAUDE_MODELS = ["claude-sonnet-4", "claude-opus-4", "claude-opus-4[1m]"]
CLAUDE_TYPES = ["input", "output", "cacheRead", "cacheCreation"]
EFFORTS = ["", "low", "medium", "high", "high"]
GROK_TYPES = ["input", "cache_read", "output", "reasoning"]
HIST_TOKEN_TYPES = ["input", "output", "total"]
HIST_BOUNDS = [1000.0, 2000.0]
PURCHASE_METRICS = ["claude_code.session.count", "claude_code.commit.count",
                    "claude_code.pull_request.count", "claude_code.lines_of_code.count",
                    "claude_code.code_edit_tool.decision", "claude_code.active_time.total",
                    "claude_code.cost.usage"]
TOOL_COMMANDS = ["git commit -m wip", "cd app && git -C . commit -am fix",
                 "git status && ls", "ls -la"]
DAY = 86_400


def _case(col: Column, pairs) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores (a small single-file
    table) over all cores before row-multiplying work; a wide scan (the
    cluster case) is left as it is, so no shuffle is added there. Checking
    the split count plans the scan only; no job runs."""
    target = parallelism(df.sparkSession)
    try:
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view on this session: leave the scan as it is
        return df
    return df.repartition(target) if splits < target else df


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"))
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.floor(F.col("value") * 100).cast("bigint").alias("amt"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _tokens(ev: DataFrame) -> DataFrame:
    k, amt = F.col("k"), F.col("amt")
    output = F.lit(10) * k + F.col("event_id") % 97
    return ev.select(
        "*",
        amt.alias("input_tokens"),
        _div(amt * (k % 50), 100).alias("cached_input_tokens"),
        F.when(F.col("event_type") == "click", _div(amt * (k % 10), 100))
        .alias("cache_write_input_tokens"),
        output.cast("bigint").alias("output_tokens"),
        _div(output * (k % 40), 100).alias("reasoning_output_tokens"),
        (amt + output).cast("bigint").alias("total_tokens"),
        F.when((F.col("event_type") == "signup") & (k % 11 == 0),
               F.concat(F.lit("ts-"), F.col("event_id").cast("string")))
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .alias("ts_raw"))


def ledger_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's usage record in its home file, plus replayed copies: a
    fork copy (event_id % 25 = 0) in an active ``-fork`` file under another
    model, and a stale archive copy (event_id % 40 = 0) whose basename is
    also active (so discovery drops it). Users with user_id % 9 = 0 keep
    their home file in the archive only, so there the active fork copy wins.

    One scan: the placements of an event are an array exploded in place.
    """
    ev = _tokens(base_events(spark, sf_dir))
    uid = F.col("user_id").cast("string")
    home_path = F.when(F.col("user_id") % 9 == 0,
                       F.concat(F.lit("archived_sessions/u"), uid, F.lit(".jsonl"))) \
        .otherwise(F.concat(F.lit("sessions/u"), uid, F.lit("/rollout.jsonl")))
    model = _case(F.col("event_type"), MODEL_BY_EVENT)
    copy_model = _case(F.col("event_type"), COPY_MODEL_BY_EVENT)

    def place(path, m, home):
        return F.struct(path.alias("path"), m.alias("model"), F.lit(home).alias("home"))

    fork = F.when(F.col("event_id") % 25 == 0, place(
        F.concat(F.lit("sessions/u"), uid, F.lit("-fork/rollout.jsonl")), copy_model, False))
    stale = F.when(F.col("event_id") % 40 == 0, place(
        F.concat(F.lit("archived_sessions/b"), (F.col("user_id") % 4).cast("string"),
                 F.lit("/rollout.jsonl")), model, False))
    # nulls go after the explode: a filter of the array is interpreted
    places = F.array(place(home_path, model, True), fork, stale)
    return ev.select("*", F.explode(places).alias("_pl")).where(F.col("_pl").isNotNull()).select("*", "_pl.*").drop("_pl")


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONL text lines (path, ord, line) of every ledger file.

    Per placement: a turn_context line when k % 3 = 0 (so other records
    carry the file's previous model), the token_count line, a truncated
    token_count line for error events with k % 7 = 0 in the home file
    (a parse error), and a marker-free line for view events with k % 5 = 0.
    """
    p = ledger_placements(spark, sf_dir)
    us4 = F.col("us") * 4
    ctx = F.when(F.col("k") % 3 == 0, F.struct(us4.alias("ord"), F.to_json(F.struct(
        F.col("ts_raw").alias("timestamp"), F.lit("turn_context").alias("type"),
        F.struct(F.lit("/work").alias("cwd"), F.col("model").alias("model")).alias("payload")))
        .alias("line")))
    usage = F.struct(*[F.col(c) for c in ["input_tokens", "cached_input_tokens",
                                          "cache_write_input_tokens", "output_tokens",
                                          "reasoning_output_tokens", "total_tokens"]])
    tok = F.struct((us4 + 1).alias("ord"), F.to_json(F.struct(
        F.col("ts_raw").alias("timestamp"), F.lit("event_msg").alias("type"),
        F.struct(F.lit("token_count").alias("type"),
                 F.struct(usage.alias("last_token_usage")).alias("info")).alias("payload")))
        .alias("line"))
    broken = F.when(F.col("home") & (F.col("event_type") == "error") & (F.col("k") % 7 == 0),
                    F.struct((us4 + 2).alias("ord"), F.concat(
                        F.lit('{"timestamp":"'), F.col("ts_raw"),
                        F.lit('","type":"event_msg","payload":{"type":"token_count","info":{"last_tok'))
                        .alias("line")))
    noise = F.when(F.col("home") & (F.col("event_type") == "view") & (F.col("k") % 5 == 0),
                   F.struct((us4 + 3).alias("ord"), F.concat(
                       F.lit('{"timestamp":"'), F.col("ts_raw"),
                       F.lit('","type":"response_item","payload":{"type":"message"}}')).alias("line")))
    arr = F.array(ctx, tok, broken, noise)
    lines = p.select("path", F.explode(arr).alias("_l")).where(F.col("_l").isNotNull()).select("path", "_l.ord", "_l.line")
    # The order key's day is the slice used by the carry-forward scan.
    return lines.withColumn("block", F.floor(F.col("ord") / F.lit(4 * DAY * 1_000_000)))


def otlp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened OTLP data points (the shape :func:`flatten_otlp` yields),
    one per event, with identity attributes the privacy filter must drop."""
    ev = base_events(spark, sf_dir)
    k, et, amt, uid = F.col("k"), F.col("event_type"), F.col("amt"), F.col("user_id")
    pm = k % 7
    metric = (F.when(et == "click", F.lit("claude_code.token.usage"))
              .when(et == "purchase", _pick(PURCHASE_METRICS, pm))
              .when((et == "view") & (k % 4 == 3), F.lit("codex.thread.started"))
              .when(et == "view", F.lit("codex.turn.token_usage"))
              .when(et == "signup", F.lit("grok_code.token.usage"))
              .otherwise(F.lit("unknown.metric")))
    is_hist = (et == "view") & (k % 4 != 3)
    is_cost = (et == "purchase") & (pm == 6)
    model = (F.when(et == "click", _pick(CLAUDE_MODELS, k % 3))
             .when(is_cost, _pick(CLAUDE_MODELS, k % 3))
             .when(is_hist, F.lit("gpt-5.6-sol"))
             .when(et == "signup", F.when(k % 5 == 4, F.lit("grok-code-fast")).otherwise(F.lit("grok-4.6"))))
    typ = (F.when(et == "click", _pick(CLAUDE_TYPES, k % 4))
           .when((et == "purchase") & (pm == 3), F.when(k % 2 == 0, F.lit("added")).otherwise(F.lit("removed")))
           .when((et == "purchase") & (pm == 5), F.when(k % 2 == 0, F.lit("user")).otherwise(F.lit("cli")))
           .when(et == "signup", _pick(GROK_TYPES, k % 4)))
    effort = F.when(et == "click", F.nullif(_pick(EFFORTS, k % 5), F.lit("")))
    agent = (F.when(et == "click", F.when(k % 7 == 0, F.lit("reviewer")).when(k % 7 == 1, F.lit("planner")))
             .when(is_cost, F.when(_div(k, 7) % 3 == 0, F.lit("reviewer"))
                   .when(_div(k, 7) % 3 == 1, F.lit("planner"))))
    start_type = F.when((et == "purchase") & (pm == 0),
                        F.when(k % 2 == 0, F.lit("fresh")).otherwise(F.lit("agents_view")))
    decision = F.when((et == "purchase") & (pm == 4),
                      F.when(k % 2 == 0, F.lit("accept")).otherwise(F.lit("reject")))
    is_git = F.when((et == "view") & (k % 4 == 3),
                    F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")))
    token_type = F.when(is_hist, _pick(HIST_TOKEN_TYPES, k % 3))
    attrs = F.map_filter(F.create_map(
        F.lit("model"), model, F.lit("type"), typ, F.lit("effort"), effort,
        F.lit("agent.name"), agent, F.lit("start_type"), start_type,
        F.lit("decision"), decision, F.lit("is_git"), is_git, F.lit("token_type"), token_type,
        F.lit("session.id"), F.concat(F.lit("s-"), uid.cast("string")),
        F.lit("user.account_uuid"), F.concat(F.lit("acct-"), uid.cast("string")),
        F.lit("agent_name"), F.when(k % 6 == 0, F.lit("shadow"))), lambda kk, v: v.isNotNull())
    resource = F.create_map(
        F.lit("env"), F.concat(F.lit("env-"), (uid % 2).cast("string")),
        F.lit("service.instance.id"), F.concat(F.lit("host-"), uid.cast("string")),
        F.lit("user.email"), F.concat(F.lit("user"), uid.cast("string"), F.lit("@corp.example")))
    one = (et == "purchase") & pm.isin(0, 1, 2, 4) | ((et == "view") & (k % 4 == 3))
    value = (F.when(is_cost, amt / F.lit(100.0))
             .when(one, F.lit(1.0))
             .otherwise(amt.cast("double")))
    time_ns = F.col("us") * 1000
    buckets = F.array((amt <= 1000).cast("bigint"),
                      ((amt > 1000) & (amt <= 2000)).cast("bigint"),
                      (amt > 2000).cast("bigint"))
    return ev.select(
        resource.alias("resource"),
        F.concat(F.lit("producer-"), (uid % 3).cast("string")).alias("scope_name"),
        F.concat(F.lit("1."), (uid % 4).cast("string")).alias("scope_version"),
        metric.alias("metric"),
        F.when(is_hist, F.lit("histogram")).otherwise(F.lit("sum")).alias("kind"),
        F.when(uid % 10 == 0, F.lit(2)).otherwise(F.lit(1)).alias("temporality"),
        F.lit(True).alias("monotonic"),
        attrs.alias("attrs"),
        (time_ns - F.lit(1_000_000_000)).alias("start_ns"),
        time_ns.alias("time_ns"),
        F.when(~is_hist, value).alias("value"),
        F.when(is_hist, F.lit(1).cast("bigint")).alias("h_count"),
        F.when(is_hist, amt.cast("double")).alias("h_sum"),
        F.when(is_hist, buckets).alias("bucket_counts"),
        F.when(is_hist, F.array(*[F.lit(b) for b in HIST_BOUNDS])).alias("bounds"),
        "event_id")


def arrival_minute(time_ns: Column) -> Column:
    """Batch (arrival) time: end of the producer's minute, unix seconds."""
    return ((F.floor(time_ns / F.lit(60_000_000_000)) + 1) * 60).cast("bigint")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook rows: each click is one Bash call with a PreToolUse row at ts and
    a PostToolUse row an hour later; commands rotate by k % 4."""
    ev = base_events(spark, sf_dir).where(F.col("event_type") == "click")
    sec = F.floor(F.col("us") / 1_000_000).cast("bigint")
    base = ev.select(
        F.lit("Bash").alias("tool_name"),
        _pick(TOOL_COMMANDS, F.col("k") % 4).alias("command"),
        F.concat(F.lit("/work/repo-"), F.col("user_id").cast("string")).alias("cwd"),
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo"),
        F.concat(F.lit("s-"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("tool_use_id"),
        F.concat(F.lit("turn-"), _div(F.col("event_id"), 3).cast("string")).alias("turn_id"),
        sec.alias("_t"))
    pre = base.withColumn("hook_event_name", F.lit("PreToolUse")).withColumn("ts", F.col("_t"))
    post = base.withColumn("hook_event_name", F.lit("PostToolUse")).withColumn("ts", F.col("_t") + 3600)
    return pre.unionByName(post).drop("_t")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits: each purchase is a commit of the user's repository."""
    ev = base_events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return ev.select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo"),
        F.sha2(F.concat(F.lit("commit-"), F.col("event_id").cast("string")), 256).alias("sha"),
        F.floor(F.col("us") / 1_000_000).cast("bigint").alias("committed_at"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit-event log lines as the collector tails them: each purchase is
    one record; env by user."""
    ev = base_events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return ev.select(
        F.create_map(F.lit("env"), F.concat(F.lit("env-"), (F.col("user_id") % 2).cast("string")))
        .alias("resource"),
        (F.col("us") * 1000).alias("time_ns"),
        F.sha2(F.concat(F.lit("commit-"), F.col("event_id").cast("string")), 256).alias("dedupe_id"),
        F.col("event_id").alias("order"))


def commit_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit-event log as text (us, line): a JSON line per purchase and
    a broken one per error event with k % 7 = 0."""
    ev = base_events(spark, sf_dir)
    record = F.to_json(F.struct(F.sha2(F.concat(F.lit("commit-"), F.col("event_id").cast("string")), 256).alias("dedupe_id"),
                                F.lit("codex.git.commit").alias("event")))
    broken = F.concat(F.lit('{"dedupe_id": "e-'), F.col("event_id").cast("string"))
    line = F.when(F.col("event_type") == "purchase", record).when((F.col("event_type") == "error") & (F.col("k") % 7 == 0), broken)
    return ev.select("us", line.alias("line")).where(F.col("line").isNotNull())


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed identity values (``secret``): host, session, account and address
    of every user."""
    uid = F.col("user_id").cast("string")
    values = F.array(*[F.concat(F.lit(a), uid, F.lit(b)) for a, b in
                       (("host-", ""), ("s-", ""), ("acct-", ""), ("user", "@corp.example"))])
    return table(spark, sf_dir, "events").select("user_id").distinct().select(F.explode(values).alias("secret"))
