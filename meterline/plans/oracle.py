"""DuckDB oracle text for the registered queries.

Each query is written independently in plain SQL over the driver's views;
the adapters of :mod:`meterline.plans.adapters` are restated as CTEs so the
oracle never calls Spark code. Fragments are composed with :func:`with_`.
"""

from __future__ import annotations

import re

from ..sinks.text import GAUGES
from ..sources.prices import price_values

EV = """ev AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value * 100) AS BIGINT) AS amt,
         epoch_us(ts) AS us
  FROM events)"""

TOK = """tok AS (
  SELECT *, amt AS input_tokens,
         (amt * (k % 50)) // 100 AS cached_input_tokens,
         CASE WHEN event_type = 'click' THEN (amt * (k % 10)) // 100 END AS cache_write_input_tokens,
         CAST(10 * k + event_id % 97 AS BIGINT) AS output_tokens,
         ((10 * k + event_id % 97) * (k % 40)) // 100 AS reasoning_output_tokens,
         CAST(amt + 10 * k + event_id % 97 AS BIGINT) AS total_tokens,
         CASE WHEN event_type = 'signup' AND k % 11 = 0 THEN 'ts-' || CAST(event_id AS VARCHAR)
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS ts_raw,
         CASE event_type WHEN 'click' THEN 'gpt-5.6-sol' WHEN 'purchase' THEN 'gpt-5.5'
              WHEN 'view' THEN 'gpt-5.4-mini' WHEN 'signup' THEN 'grok-4.6'
              WHEN 'error' THEN 'unlisted' END AS model0,
         CASE event_type WHEN 'click' THEN 'gpt-5.5' WHEN 'purchase' THEN 'gpt-5.4-mini'
              WHEN 'view' THEN 'gpt-5.6-sol' WHEN 'signup' THEN 'unlisted'
              WHEN 'error' THEN 'grok-4.6' END AS model1
  FROM ev)"""

PLACE = """place AS (
  SELECT *, CASE WHEN user_id % 9 = 0 THEN 'archived_sessions/u' || user_id || '.jsonl'
                 ELSE 'sessions/u' || user_id || '/rollout.jsonl' END AS path,
         model0 AS model, TRUE AS home FROM tok
  UNION ALL
  SELECT *, 'sessions/u' || user_id || '-fork/rollout.jsonl', model1, FALSE FROM tok
  WHERE event_id % 25 = 0
  UNION ALL
  SELECT *, 'archived_sessions/b' || (user_id % 4) || '/rollout.jsonl', model0, FALSE FROM tok
  WHERE event_id % 40 = 0)"""

# Active files, and archived files whose basename no active file has.
FILES = """files AS (
  SELECT DISTINCT path, starts_with(path, 'archived_sessions/') AS is_archived,
         regexp_extract(path, '([^/]*)$', 1) AS basename
  FROM place),
kept_files AS (
  SELECT path, is_archived FROM files f
  WHERE NOT is_archived
     OR NOT EXISTS (SELECT 1 FROM files a WHERE NOT a.is_archived AND a.basename = f.basename))"""

# S3: usage rows with the model carried from the file's last turn_context.
RECS = """lines AS (
  SELECT p.path, p.us * 4 AS ord, p.model AS ctx_model, NULL AS is_usage, p.* EXCLUDE (path, model)
  FROM place p JOIN kept_files USING (path) WHERE p.k % 3 = 0
  UNION ALL
  SELECT p.path, p.us * 4 + 1, NULL, TRUE, p.* EXCLUDE (path, model)
  FROM place p JOIN kept_files USING (path)),
recs AS (
  SELECT l.*, k2.is_archived,
         coalesce(last_value(ctx_model IGNORE NULLS) OVER (
           PARTITION BY l.path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           'unknown') AS model
  FROM lines l JOIN kept_files k2 USING (path)),
usage AS (
  SELECT path, ord, is_archived, ts_raw, model, input_tokens, cached_input_tokens,
         cache_write_input_tokens, output_tokens, reasoning_output_tokens, total_tokens
  FROM recs WHERE is_usage)"""

# First in discovery order per (raw timestamp, six raw values).
KEPT = """ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY ts_raw, input_tokens, cached_input_tokens, cache_write_input_tokens,
                 output_tokens, reasoning_output_tokens, total_tokens
    ORDER BY is_archived, string_split(path, '/'), ord) AS rn,
    count(*) OVER (
    PARTITION BY ts_raw, input_tokens, cached_input_tokens, cache_write_input_tokens,
                 output_tokens, reasoning_output_tokens, total_tokens) AS copies
  FROM usage),
kept AS (
  SELECT path, ord, ts_raw, model, CAST(copies AS BIGINT) AS copies,
         input_tokens AS input, cached_input_tokens AS cached_input,
         coalesce(cache_write_input_tokens, 0) AS cache_write_input,
         output_tokens AS output, reasoning_output_tokens AS reasoning_output,
         total_tokens AS total
  FROM ranked WHERE rn = 1)"""

LONG = """long AS (
  SELECT model, ts_raw, token_type, value FROM kept
  UNPIVOT (value FOR token_type IN (input, cached_input, cache_write_input, output,
                                     reasoning_output, total))
  WHERE value > 0)"""

TOTALS = """totals AS (
  SELECT model, token_type, CAST(sum(value) AS BIGINT) AS value FROM long
  GROUP BY model, token_type)"""

LEDGER = [EV, TOK, PLACE, FILES, RECS, KEPT, LONG, TOTALS]


def prices_cte() -> str:
    rows = ",\n    ".join(
        f"('{s}', '{m}', '{t}', CAST('{p}' AS DECIMAL(12,6)), CAST('{u:f}' AS DECIMAL(18,12)), '{tier}')"
        for s, m, t, p, u, tier in price_values())
    return ("prices AS (SELECT * FROM (VALUES\n    " + rows +
            "\n  ) AS v(source, model, type, price, usd_per_token, pricing_tier))")


def with_(ctes: list[str], body: str) -> str:
    """``WITH ctes body``; a body that opens with more CTEs continues the list."""
    head = body.lstrip()
    sep = "\n" if head[:6].upper() == "SELECT" else ",\n"
    return "WITH " + ",\n".join(ctes) + sep + head


# ---- ledger history ----------------------------------------------------------

END = 1706572800          # backfill cutoff 2024-01-30T00:00:00Z
NOW = "(SELECT max(t) FROM samples)"    # instant evaluation time: the last sample
TOKS = "input, cached_input, cache_write_input, output, reasoning_output, total"

HOURLY_ALL = f"""parsed AS (
  SELECT *, TRY_CAST(replace(ts_raw, 'Z', '') AS TIMESTAMP) AS pts FROM kept),
hourly AS (
  SELECT (epoch_us(pts) // 1000000) // 3600 * 3600 AS t, model, token_type,
         CAST(sum(value) AS BIGINT) AS value
  FROM parsed UNPIVOT (value FOR token_type IN ({TOKS}))
  WHERE pts IS NOT NULL AND value > 0
  GROUP BY ALL)"""
HOURLY = HOURLY_ALL.replace("pts IS NOT NULL", "pts IS NOT NULL AND pts < TIMESTAMP '2024-01-30 00:00:00'")

GRID = f"""firsts AS (SELECT model, min(t) AS f FROM hourly GROUP BY model),
grid AS (SELECT model, unnest(generate_series(f, CAST({END - 3600} AS BIGINT), 3600)) AS t FROM firsts),
wide AS (
  SELECT t, model,
         sum(value) FILTER (WHERE token_type = 'input') AS input,
         sum(value) FILTER (WHERE token_type = 'cached_input') AS cached_input,
         sum(value) FILTER (WHERE token_type = 'cache_write_input') AS cache_write_input,
         sum(value) FILTER (WHERE token_type = 'output') AS output,
         sum(value) FILTER (WHERE token_type = 'reasoning_output') AS reasoning_output,
         sum(value) FILTER (WHERE token_type = 'total') AS total
  FROM hourly GROUP BY t, model),
gridw AS (
  SELECT g.t, g.model, coalesce(w.input, 0) AS input, coalesce(w.cached_input, 0) AS cached_input,
         coalesce(w.cache_write_input, 0) AS cache_write_input, coalesce(w.output, 0) AS output,
         coalesce(w.reasoning_output, 0) AS reasoning_output, coalesce(w.total, 0) AS total
  FROM grid g LEFT JOIN wide w USING (t, model)),
cum AS (
  SELECT t, model, sum(input) OVER w AS input, sum(cached_input) OVER w AS cached_input,
         sum(cache_write_input) OVER w AS cache_write_input, sum(output) OVER w AS output,
         sum(reasoning_output) OVER w AS reasoning_output, sum(total) OVER w AS total
  FROM gridw
  WINDOW w AS (PARTITION BY model ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
grid_long AS (
  SELECT t, model, token_type, CAST(value AS BIGINT) AS value
  FROM cum UNPIVOT (value FOR token_type IN ({TOKS}))),
hist AS (
  SELECT t, model, greatest(input - cached_input - cache_write_input, 0) AS input,
         cached_input AS cacheRead, cache_write_input AS cacheCreation,
         greatest(output - reasoning_output, 0) AS output, reasoning_output
  FROM cum),
hist_long AS (
  SELECT t, model, type, CAST(value AS BIGINT) AS value
  FROM hist UNPIVOT (value FOR type IN (input, cacheRead, cacheCreation, output, reasoning_output)))"""

# The live ledger: the same series to the last active hour of the data.
GRID_ALL = GRID.replace(f"CAST({END - 3600} AS BIGINT)", "(SELECT max(t) FROM hourly)")
HISTORY = LEDGER + [HOURLY, GRID]

# ---- collector lane and samples ---------------------------------------------------

LABELS = ["agent_name", "decision", "effort", "is_git", "model", "start_type", "token_type", "type"]
LAB = ", ".join(LABELS)
SLAB = "env, " + LAB + ", le"          # sample label columns
CONTRACT = (r"^(claude_code[.](token[.]usage|cost[.]usage|commit[.]count|pull_request[.]count"
            r"|lines_of_code[.]count|code_edit_tool[.]decision|active_time[.]total|session[.]count)"
            r"|codex[.](turn[.]token_usage|thread[.]started)|grok_code[.]token[.]usage)$")
SERIES = [
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
NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SERIES) + \
    ") AS v(metric, series))"

PTS = f"""pts AS (
  SELECT event_id, user_id, k, amt, us, event_type,
    CASE WHEN event_type = 'click' THEN 'claude_code.token.usage'
         WHEN event_type = 'purchase' THEN (['claude_code.session.count', 'claude_code.commit.count',
              'claude_code.pull_request.count', 'claude_code.lines_of_code.count',
              'claude_code.code_edit_tool.decision', 'claude_code.active_time.total',
              'claude_code.cost.usage'])[k % 7 + 1]
         WHEN event_type = 'view' AND k % 4 = 3 THEN 'codex.thread.started'
         WHEN event_type = 'view' THEN 'codex.turn.token_usage'
         WHEN event_type = 'signup' THEN 'grok_code.token.usage'
         ELSE 'unknown.metric' END AS metric,
    (event_type = 'view' AND k % 4 <> 3) AS is_hist,
    CASE WHEN user_id % 10 = 0 THEN 2 ELSE 1 END AS temporality,
    'env-' || (user_id % 2) AS env,
    CASE WHEN event_type = 'click' THEN CASE k % 7 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'planner' ELSE '' END
         WHEN event_type = 'purchase' AND k % 7 = 6 THEN
              CASE (k // 7) % 3 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'planner' ELSE '' END
         ELSE '' END AS agent_name,
    CASE WHEN event_type = 'purchase' AND k % 7 = 4 THEN CASE WHEN k % 2 = 0 THEN 'accept' ELSE 'reject' END
         ELSE '' END AS decision,
    CASE WHEN event_type = 'click' THEN (['', 'low', 'medium', 'high', 'high'])[k % 5 + 1] ELSE '' END AS effort,
    CASE WHEN event_type = 'view' AND k % 4 = 3 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
         ELSE '' END AS is_git,
    CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND k % 7 = 6)
              THEN (['claude-sonnet-4', 'claude-opus-4', 'claude-opus-4[1m]'])[k % 3 + 1]
         WHEN event_type = 'view' AND k % 4 <> 3 THEN 'gpt-5.6-sol'
         WHEN event_type = 'signup' THEN CASE WHEN k % 5 = 4 THEN 'grok-code-fast' ELSE 'grok-4.6' END
         ELSE '' END AS model,
    CASE WHEN event_type = 'purchase' AND k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'fresh' ELSE 'agents_view' END
         ELSE '' END AS start_type,
    CASE WHEN event_type = 'view' AND k % 4 <> 3 THEN (['input', 'output', 'total'])[k % 3 + 1]
         ELSE '' END AS token_type,
    CASE WHEN event_type = 'click' THEN (['input', 'output', 'cacheRead', 'cacheCreation'])[k % 4 + 1]
         WHEN event_type = 'purchase' AND k % 7 = 3 THEN CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END
         WHEN event_type = 'purchase' AND k % 7 = 5 THEN CASE WHEN k % 2 = 0 THEN 'user' ELSE 'cli' END
         WHEN event_type = 'signup' THEN (['input', 'cache_read', 'output', 'reasoning'])[k % 4 + 1]
         ELSE '' END AS type,
    CASE WHEN event_type = 'purchase' AND k % 7 = 6 THEN amt / 100.0
         WHEN (event_type = 'purchase' AND k % 7 IN (0, 1, 2, 4)) OR (event_type = 'view' AND k % 4 = 3) THEN 1.0
         ELSE CAST(amt AS DOUBLE) END AS value,
    CAST(amt <= 1000 AS BIGINT) AS b0, CAST(amt > 1000 AND amt <= 2000 AS BIGINT) AS b1,
    CAST(amt > 2000 AS BIGINT) AS b2,
    (us // 60000000 + 1) * 60 AS batch_t
  FROM ev),
adm AS (SELECT * FROM pts WHERE regexp_matches(metric, '{CONTRACT}') AND temporality = 1),
sumd AS (
  SELECT batch_t, metric, env, {LAB}, sum(value) AS value
  FROM adm WHERE NOT is_hist GROUP BY ALL),
hd AS (
  SELECT batch_t, metric, env, {LAB}, count(*) AS h_count, sum(CAST(amt AS DOUBLE)) AS h_sum,
         sum(b0) AS b0, sum(b1) AS b1, sum(b2) AS b2
  FROM adm WHERE is_hist GROUP BY ALL)"""

K_OTLP = "metric, part, " + SLAB


def t1(src: str, keys: str, out: str) -> str:
    """T1 in SQL: stale restart and running sum."""
    return f"""{out}_b AS (
  SELECT *, coalesce(t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) > 86400, false) AS restart,
         sum(value) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS total
  FROM {src}),
{out} AS (
  SELECT *, total - coalesce(last_value(CASE WHEN restart THEN total - value END IGNORE NULLS) OVER (
             PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS cum
  FROM {out}_b)"""


DROWS = f"""drows AS (
  SELECT metric, '' AS part, env, {LAB}, '' AS le, batch_t AS t, value FROM sumd
  UNION ALL SELECT metric, 'sum', env, {LAB}, '', batch_t, h_sum FROM hd
  UNION ALL SELECT metric, 'count', env, {LAB}, '', batch_t, CAST(h_count AS DOUBLE) FROM hd
  UNION ALL SELECT metric, 'bucket', env, {LAB}, '1000', batch_t, CAST(b0 AS DOUBLE) FROM hd
  UNION ALL SELECT metric, 'bucket', env, {LAB}, '2000', batch_t, CAST(b0 + b1 AS DOUBLE) FROM hd
  UNION ALL SELECT metric, 'bucket', env, {LAB}, '+Inf', batch_t, CAST(b0 + b1 + b2 AS DOUBLE) FROM hd)"""

OTLP_SAMPLES = f"""otlp_samples AS (
  SELECT CASE WHEN part = '' THEN series ELSE series || '_' || part END AS name, {SLAB}, t,
         CAST(cum AS DOUBLE) AS value
  FROM otlp_cum JOIN names USING (metric))"""

COMMITS = f"""clog AS (
  SELECT 'env-' || (user_id % 2) AS env, (us // 60000000 + 1) * 60 AS t FROM ev
  WHERE event_type = 'purchase'),
cdel AS (
  SELECT 'codex.git.commit.count' AS metric, env, t, CAST(count(*) AS DOUBLE) AS value
  FROM clog GROUP BY ALL),
{t1('cdel', 'metric, env', 'commit_cum')},
commit_samples AS (
  SELECT 'codex_git_commit_count_total' AS name, env, '' AS agent_name, '' AS decision, '' AS effort,
         '' AS is_git, '' AS model, '' AS start_type, '' AS token_type, '' AS type, '' AS le, t,
         CAST(cum AS DOUBLE) AS value
  FROM commit_cum)"""

LEDGER_SAMPLES = """ledger_samples AS (
  SELECT 'codex_ledger_token_usage_total' AS name, 'env-0' AS env, '' AS agent_name, '' AS decision,
         '' AS effort, '' AS is_git, model, '' AS start_type, token_type, '' AS type, '' AS le, t,
         CAST(value AS DOUBLE) AS value
  FROM grid_long)"""

SAMPLES = f"""samples AS (
  SELECT name, {SLAB}, t, value FROM otlp_samples
  UNION ALL SELECT name, {SLAB}, t, value FROM commit_samples
  UNION ALL SELECT name, {SLAB}, t, value FROM ledger_samples)"""

STEPS = f"""steps AS (
  SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY name, {SLAB} ORDER BY t) AS prev FROM samples)),
inc1h AS (
  SELECT name, {SLAB}, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS t, sum(step) AS value
  FROM steps GROUP BY ALL)"""

COLLECT = [EV, PTS, DROWS, NAMES, t1("drows", K_OTLP, "otlp_cum"), OTLP_SAMPLES]
ALL = LEDGER + [HOURLY_ALL, GRID_ALL] + [PTS, DROWS, NAMES, t1("drows", K_OTLP, "otlp_cum"), OTLP_SAMPLES,
                                 COMMITS, LEDGER_SAMPLES, SAMPLES, STEPS]


def latest(now: str, src: str = "samples", name: str = "latest") -> str:
    return f"""{name} AS (
  SELECT name, {SLAB}, max(t) AS t, arg_max(value, t) AS value FROM {src}
  WHERE t <= {now} GROUP BY name, {SLAB} HAVING max(t) > {now} - 90000)"""


CODEX_DIS = """codex_w AS (
  SELECT model,
         sum(value) FILTER (WHERE token_type = 'input') AS input,
         sum(value) FILTER (WHERE token_type = 'cached_input') AS cached_input,
         sum(value) FILTER (WHERE token_type = 'cache_write_input') AS cache_write_input,
         sum(value) FILTER (WHERE token_type = 'output') AS output,
         sum(value) FILTER (WHERE token_type = 'reasoning_output') AS reasoning_output
  FROM totals GROUP BY model),
codex_dis AS (
  SELECT 'codex' AS source, model, type, CAST(value AS DOUBLE) AS value FROM (
    SELECT model,
           CASE WHEN input IS NOT NULL THEN greatest(input - coalesce(
             CASE WHEN cached_input IS NULL AND cache_write_input IS NULL THEN NULL
                  ELSE coalesce(cached_input, 0) + coalesce(cache_write_input, 0) END, 0), 0) END AS input,
           cached_input AS cacheRead, cache_write_input AS cacheCreation,
           CASE WHEN output IS NOT NULL THEN greatest(output - coalesce(reasoning_output, 0), 0) END AS output,
           reasoning_output
    FROM codex_w) UNPIVOT (value FOR type IN (input, cacheRead, cacheCreation, output, reasoning_output)))"""

GROK = f"""{latest(NOW)},
grok_latest AS (SELECT env, model, type, value FROM latest WHERE name = 'grok_code_token_usage_total'),
grok_w AS (
  SELECT env, model,
         sum(value) FILTER (WHERE type = 'input') AS input,
         sum(value) FILTER (WHERE type = 'cache_read') AS cache_read,
         sum(value) FILTER (WHERE type = 'output') AS output,
         sum(value) FILTER (WHERE type = 'reasoning') AS reasoning
  FROM grok_latest GROUP BY env, model),
grok_dis AS (
  SELECT 'grok_code' AS source, env, model, type, value FROM (
    SELECT env, model,
           CASE WHEN input IS NOT NULL THEN greatest(input - coalesce(cache_read, 0.0), 0.0) END AS input,
           cache_read AS cacheRead,
           CASE WHEN output IS NOT NULL THEN greatest(output - coalesce(reasoning, 0.0), 0.0) END AS output,
           reasoning AS reasoning_output
    FROM grok_w) UNPIVOT (value FOR type IN (input, cacheRead, output, reasoning_output))),
{CODEX_DIS},
claude_latest AS (
  SELECT 'claude_code' AS source, env, model, type, effort, agent_name, value FROM latest
  WHERE name = 'claude_code_token_usage_tokens_total'),
ai AS (
  SELECT source, env, model, type, effort, agent_name, value FROM claude_latest
  UNION ALL SELECT source, 'env-0', model, type, '', '', value FROM codex_dis
  UNION ALL SELECT source, env, model, type, '', '', value FROM grok_dis),
basis AS (
  SELECT 'codex' AS source, model, type, CAST(tokens AS BIGINT) AS tokens FROM (
    SELECT model,
           CASE WHEN input IS NOT NULL THEN greatest(input - coalesce(cached_input, 0)
                - coalesce(cache_write_input, 0), 0) END AS input,
           cached_input AS cacheRead, cache_write_input AS cacheCreation, output
    FROM codex_w) UNPIVOT (tokens FOR type IN (input, cacheRead, cacheCreation, output))
  UNION ALL
  SELECT 'grok_code', model, type, CAST(tokens AS BIGINT) FROM (
    SELECT model,
           CASE WHEN sum(input) IS NOT NULL THEN greatest(sum(input) - coalesce(sum(cache_read), 0.0), 0.0) END AS input,
           sum(cache_read) AS cacheRead, sum(output) AS output
    FROM grok_w GROUP BY model) UNPIVOT (tokens FOR type IN (input, cacheRead, output)))"""

# ai_token_usage series over time: Claude, codex backfill categories, grok as-of
AI_SERIES = """grok_pw AS (
  SELECT env, model, t,
         sum(value) FILTER (WHERE type = 'input') AS input,
         sum(value) FILTER (WHERE type = 'cache_read') AS cache_read,
         sum(value) FILTER (WHERE type = 'output') AS output,
         sum(value) FILTER (WHERE type = 'reasoning') AS reasoning
  FROM samples WHERE name = 'grok_code_token_usage_total' GROUP BY env, model, t),
grok_c AS (
  SELECT env, model, t, last_value(input IGNORE NULLS) OVER w AS input,
         last_value(cache_read IGNORE NULLS) OVER w AS cache_read,
         last_value(output IGNORE NULLS) OVER w AS output,
         last_value(reasoning IGNORE NULLS) OVER w AS reasoning
  FROM grok_pw
  WINDOW w AS (PARTITION BY env, model ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
grok_series AS (
  SELECT 'grok_code' AS source, env, model, type, '' AS effort, '' AS agent_name, t, value FROM (
    SELECT env, model, t,
           CASE WHEN input IS NOT NULL THEN greatest(input - coalesce(cache_read, 0.0), 0.0) END AS input,
           cache_read AS cacheRead,
           CASE WHEN output IS NOT NULL THEN greatest(output - coalesce(reasoning, 0.0), 0.0) END AS output,
           reasoning AS reasoning_output
    FROM grok_c) UNPIVOT (value FOR type IN (input, cacheRead, output, reasoning_output))),
claude_series AS (
  SELECT 'claude_code' AS source, env, model, type, effort, agent_name, t, value FROM samples
  WHERE name = 'claude_code_token_usage_tokens_total'),
codex_series AS (
  SELECT 'codex' AS source, 'env-0' AS env, model, type, '' AS effort, '' AS agent_name, t,
         CAST(value AS DOUBLE) AS value FROM hist_long),
ai_series AS (
  SELECT * FROM claude_series UNION ALL SELECT * FROM codex_series UNION ALL SELECT * FROM grok_series),
ai_steps AS (
  SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY source, env, model, type, effort, agent_name ORDER BY t)
        AS prev FROM ai_series)),
ai_inc AS (
  SELECT source, env, model, type, effort, agent_name, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS t,
         sum(step) AS value
  FROM ai_steps GROUP BY ALL)"""

THREADS = """th AS (SELECT env, is_git, t, value FROM samples WHERE name = 'codex_thread_started_total'),
th_d AS (
  SELECT env, t, sum(value - coalesce(prev, 0.0)) AS d FROM (
    SELECT *, lag(value) OVER (PARTITION BY env, is_git ORDER BY t) AS prev FROM th) GROUP BY env, t),
th_series AS (
  SELECT env, t, sum(d) OVER (PARTITION BY env ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM th_d),
th_inc AS (
  SELECT CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS t, sum(step) AS value FROM (
    SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS step
    FROM (SELECT *, lag(value) OVER (PARTITION BY env ORDER BY t) AS prev FROM th_series))
  GROUP BY 1)"""


def div(a: str, b: str) -> str:
    """PromQL division: x/0 = +-Inf, 0/0 = NaN."""
    return (f"CASE WHEN isnan({a}) OR isnan({b}) THEN 'nan'::DOUBLE WHEN {b} <> 0 THEN {a} / {b} "
            f"WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END")


def _hmac_sql(secret: bytes, msg: str) -> str:
    from ..functions.scalars import _hmac_pads
    ipad, opad = _hmac_pads(secret)
    return (f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({msg}))))")


def claude_hourly(typ: str, name: str) -> str:
    return f"""{name} AS (
  SELECT t, model, sum(value) AS value FROM inc1h
  WHERE name = 'claude_code_token_usage_tokens_total' AND type = '{typ}' GROUP BY t, model)"""


TOOL_CALLS = """clicks AS (
  SELECT *, (['git commit -m wip', 'cd app && git -C . commit -am fix', 'git status && ls', 'ls -la'])[k % 4 + 1]
         AS command,
         '/work/repo-' || user_id AS cwd, 'repo-' || user_id AS repo,
         'call-' || event_id AS tool_use_id, 'turn-' || (event_id // 3) AS turn_id,
         us // 1000000 AS started
  FROM ev WHERE event_type = 'click'),
calls AS (
  SELECT substr(sha256(tool_use_id || chr(0) || turn_id || chr(0) || command || chr(0) || cwd), 1, 24)
         AS invocation_id, repo, started, started + 3600 AS ended
  FROM clicks WHERE k % 4 IN (0, 1)),
commits AS (
  SELECT 'repo-' || user_id AS repo, sha256('commit-' || event_id) AS sha, us // 1000000 AS committed_at
  FROM ev WHERE event_type = 'purchase'),
attributed AS (
  SELECT c.invocation_id, c.repo, m.sha, m.committed_at, c.started, c.ended
  FROM calls c JOIN commits m ON c.repo = m.repo
   AND m.committed_at >= c.started - 5 AND m.committed_at <= c.ended + 5
  QUALIFY c.started <= min(c.ended) OVER (PARTITION BY c.repo, m.sha))"""


def oracles() -> dict[str, str]:
    P = prices_cte()
    L = LEDGER
    H = HISTORY
    A = ALL
    lab_out = f"name, {SLAB}, t, round(value, 6) AS value"
    q: dict[str, str] = {}

    # ledger lane
    q["usage_records"] = with_(L, """SELECT path, ts_raw, model, input_tokens AS input,
      cached_input_tokens AS cached_input, coalesce(cache_write_input_tokens, 0) AS cache_write_input,
      output_tokens AS output, reasoning_output_tokens AS reasoning_output, total_tokens AS total
      FROM usage""")
    q["dedup_replays"] = with_(L, """SELECT path, ts_raw, model, copies, input, cached_input,
      cache_write_input, output, reasoning_output, total FROM kept""")
    q["scan_stats"] = with_(L, """SELECT
      CAST((SELECT count(*) FROM kept_files) AS BIGINT) AS files_scanned,
      CAST((SELECT count(*) FROM place p JOIN kept_files USING (path)
            WHERE p.home AND p.event_type = 'error' AND p.k % 7 = 0) AS BIGINT) AS parse_errors,
      CAST((SELECT count(*) FROM usage) - (SELECT count(*) FROM kept) AS BIGINT) AS duplicate_records,
      CAST((SELECT count(*) FROM kept) AS BIGINT) AS records_kept,
      1 AS scan_ok""")
    q["ledger_totals"] = with_(L, "SELECT model, token_type, value FROM totals")
    q["turn_records"] = with_(L, "SELECT model, CAST(count(*) AS BIGINT) AS records FROM kept GROUP BY model")
    q["hourly_usage"] = with_(L + [HOURLY], "SELECT t, model, token_type, value FROM hourly")
    q["hourly_grid"] = with_(H, "SELECT t, model, token_type, value FROM grid_long")
    q["history_summary"] = with_(H, f"""SELECT
      CAST((SELECT count(*) FROM grid_long WHERE token_type = 'input') * 5 AS BIGINT) AS samples,
      CAST((SELECT count(DISTINCT t) FROM hourly) AS BIGINT) AS hours,
      CAST((SELECT count(DISTINCT model) FROM hourly) AS BIGINT) AS models,
      (SELECT min(t) FROM hourly) AS first_hour, (SELECT max(t) FROM hourly) AS last_hour,
      CAST((SELECT sum(value) FROM grid_long WHERE t = {END - 3600}
            AND token_type IN ('input', 'output')) AS BIGINT) AS final_input_output""")
    q["openmetrics_history"] = with_(H, """SELECT t, model,
      CAST(list_position(['input', 'cacheRead', 'cacheCreation', 'output', 'reasoning_output'], type) AS INTEGER) AS pos,
      'ai_token_usage_tokens_total{env="env-0",instance="host.docker.internal:9314",job="codex-ledger",model="'
        || replace(replace(replace(model, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')
        || '",source="codex",type="' || type || '"} ' || value || ' ' || t AS line
      FROM hist_long
      UNION ALL SELECT NULL, NULL, NULL, '# EOF'""")
    q["exposition_text"] = with_(L, """
      SELECT 0 AS section, '' AS model, 'a' AS token_type,
        '# HELP codex_ledger_token_usage_total Ledger tokens by model and token_type, replay-deduplicated.' AS line
      UNION ALL SELECT 0, '', 'b', '# TYPE codex_ledger_token_usage_total counter'
      UNION ALL SELECT 2, '', 'a', '# HELP codex_ledger_turn_records_total Deduplicated token_count records by model.'
      UNION ALL SELECT 2, '', 'b', '# TYPE codex_ledger_turn_records_total counter'
      UNION ALL SELECT 1, model, token_type, 'codex_ledger_token_usage_total{env="env-0",model="' || model
        || '",token_type="' || token_type || '"} ' || value FROM totals
      UNION ALL SELECT 3, model, '', 'codex_ledger_turn_records_total{env="env-0",model="' || model
        || '"} ' || count(*) FROM kept GROUP BY model""")
    q["corpus_shrunk"] = with_(L, f"""kp AS (
        SELECT *, TRY_CAST(replace(ts_raw, 'Z', '') AS TIMESTAMP) AS pts,
               CAST(regexp_extract(path, 'u(\\d+)', 1) AS BIGINT) AS uid FROM kept),
      daily AS (
        SELECT (epoch_us(pts) // 1000000) // 86400 - (SELECT min(epoch_us(pts)) // 86400000000 FROM kp) AS day, (uid % 13 = 0) AS gone, model, token_type,
               sum(value) AS value
        FROM kp UNPIVOT (value FOR token_type IN ({TOKS}))
        WHERE pts IS NOT NULL AND value > 0 GROUP BY ALL),
      scans AS (SELECT unnest(range(1, (SELECT max(epoch_us(pts)) // 86400000000 - min(epoch_us(pts)) // 86400000000 FROM kp) + 2)) AS scan),
      snap AS (
        SELECT scan, model, token_type, CAST(sum(value) AS BIGINT) AS value
        FROM daily JOIN scans ON day < scan AND NOT (gone AND scan >= 20) GROUP BY ALL),
      prev AS (SELECT scan + 1 AS scan, model, token_type, value AS prev_value FROM snap),
      cmp AS (
        SELECT p.scan, CASE WHEN coalesce(s.value, 0) < p.prev_value THEN 1 ELSE 0 END AS d
        FROM prev p LEFT JOIN snap s USING (scan, model, token_type)),
      flags AS (SELECT scan, max(d) AS d FROM cmp GROUP BY scan),
      per AS (SELECT s.scan, coalesce(f.d, 0) AS d FROM scans s
              LEFT JOIN flags f USING (scan))
      SELECT scan, CAST(max(d) OVER (ORDER BY scan ROWS UNBOUNDED PRECEDING) AS INTEGER) AS shrunk FROM per""")
    # The live side has the same common tables under names of its own.
    live = re.sub(r"\b(parsed|hourly|firsts|grid|wide|gridw|cum|grid_long|hist|hist_long)\b", r"live_\1", HOURLY_ALL + ",\n" + GRID_ALL)
    q["splice_check"] = with_(H + [live], f"""h AS (SELECT model, type, max(t) AS history_end FROM hist_long GROUP BY ALL),
      l AS (SELECT model, type, min(t) AS live_start FROM live_hist_long WHERE t >= {END} GROUP BY ALL)
      SELECT h.model, h.type, history_end, live_start, coalesce(history_end < live_start, false) AS ok
      FROM h LEFT JOIN l USING (model, type)""")

    # cost
    G = A + [GROK]
    q["disjoint_codex"] = with_(L + [CODEX_DIS],
                                "SELECT source, model, type, round(value, 6) AS value FROM codex_dis")
    q["disjoint_grok"] = with_(G, "SELECT source, env, model, type, round(value, 6) AS value FROM grok_dis")
    q["ai_tokens"] = with_(G, """SELECT source, env, model, type, effort, agent_name,
      round(value, 6) AS value FROM ai""")
    q["api_cost"] = with_(G + [P], """SELECT b.source, b.model,
      round(CAST(sum(CAST(b.tokens AS DECIMAL(18,0)) * p.usd_per_token) AS DOUBLE), 9) AS cost_usd
      FROM basis b JOIN prices p USING (source, model, type) GROUP BY b.source, b.model""")
    q["ai_cost"] = with_(G + [P], """SELECT b.source, b.model,
      round(CAST(sum(CAST(b.tokens AS DECIMAL(18,0)) * p.usd_per_token) AS DOUBLE), 9) AS cost_usd,
      'api_estimate' AS cost_kind
      FROM basis b JOIN prices p USING (source, model, type) GROUP BY b.source, b.model
      UNION ALL
      SELECT 'claude_code', model, round(sum(value), 6), 'emitter_estimate' FROM latest
      WHERE name = 'claude_code_cost_usage_USD_total' GROUP BY model""")
    q["unpriced_tokens"] = with_(G + [P], """SELECT source, model, type, CAST(sum(tokens) AS BIGINT) AS tokens
      FROM basis b WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.source = b.source AND p.model = b.model
                                     AND p.type = b.type)
      GROUP BY ALL""")
    q["cache_hit_rate"] = with_(G, f"""g AS (
        SELECT source, sum(value) FILTER (WHERE type = 'cacheRead') AS num,
               sum(value) FILTER (WHERE type IN ('input', 'cacheRead', 'cacheCreation')) AS den
        FROM ai GROUP BY source)
      SELECT source, round({div('num', 'den')}, 6) AS hit_rate FROM g
      WHERE num IS NOT NULL AND den IS NOT NULL""")
    q["price_join"] = with_(G + [P], """SELECT b.source, b.model, b.type, b.tokens,
      round(CAST(CAST(b.tokens AS DECIMAL(18,0)) * p.usd_per_token AS DOUBLE), 9) AS cost_usd
      FROM basis b JOIN prices p USING (source, model, type)""")
    q["price_at"] = with_(L + [HOURLY_ALL, GRID_ALL, P], """ph AS (
        SELECT model, type, CAST(usd_per_token * 0.8 AS DECIMAL(18,12)) AS usd_per_token,
               NULL::DATE AS effective_from, DATE '2024-01-15' AS effective_to
        FROM prices WHERE source = 'codex'
        UNION ALL
        SELECT model, type, usd_per_token, DATE '2024-01-16', NULL::DATE FROM prices WHERE source = 'codex'),
      hs AS (
        SELECT model, type, t, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value
                                    ELSE value - prev END AS step
        FROM (SELECT model, type, t, CAST(value AS DOUBLE) AS value,
                     lag(CAST(value AS DOUBLE)) OVER (PARTITION BY model, type ORDER BY t) AS prev
              FROM hist_long WHERE type <> 'reasoning_output')),
      hi AS (SELECT model, type, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS t, sum(step) AS value
             FROM hs GROUP BY ALL)
      SELECT hi.t, hi.model,
             round(CAST(sum(CAST(hi.value AS DECIMAL(18,0)) * ph.usd_per_token) AS DOUBLE), 9) AS cost_usd
      FROM hi JOIN ph ON hi.model = ph.model AND hi.type = ph.type
       AND coalesce(CAST(epoch_ms(hi.t * 1000) AS DATE) >= ph.effective_from, true)
       AND coalesce(CAST(epoch_ms(hi.t * 1000) AS DATE) <= ph.effective_to, true)
      GROUP BY hi.t, hi.model""")

    valid = """ph AS (
        SELECT source, model, type, CAST(usd_per_token * 0.8 AS DECIMAL(18,12)) AS usd_per_token,
               NULL::DATE AS since, DATE '2024-01-15' AS until FROM prices WHERE source = 'codex'
        UNION ALL SELECT source, model, type, usd_per_token, DATE '2024-01-16', NULL::DATE FROM prices WHERE source = 'codex'
        UNION ALL SELECT source, model, type, usd_per_token, NULL::DATE, NULL::DATE FROM prices WHERE source <> 'codex')"""
    q["ai_cost_total"] = with_(G + [P, valid], f"""n AS (SELECT CAST(epoch_ms({NOW} * 1000) AS DATE) AS today)
      SELECT 'api_estimate' AS cost_kind,
             round(CAST(sum(CAST(b.tokens AS DECIMAL(18,0)) * ph.usd_per_token) AS DOUBLE), 6) AS cost_usd
      FROM basis b JOIN ph USING (source, model, type), n
      WHERE coalesce(today >= since, true) AND coalesce(today <= until, true)
      UNION ALL
      SELECT 'emitter_estimate', round(sum(value), 6) FROM latest WHERE name = 'claude_code_cost_usage_USD_total'""")
    q["ai_cost_over_time"] = with_(A + [AI_SERIES, P, valid], """bi AS (
        SELECT source, model, CASE WHEN type = 'reasoning_output' THEN 'output' ELSE type END AS type, t, sum(value) AS value
        FROM ai_inc WHERE source <> 'claude_code' GROUP BY ALL)
      SELECT bi.t, bi.source, bi.model, 'api_estimate' AS cost_kind,
             round(CAST(sum(CAST(bi.value AS DECIMAL(18,0)) * ph.usd_per_token) AS DOUBLE), 9) AS cost_usd
      FROM bi JOIN ph ON bi.source = ph.source AND bi.model = ph.model AND bi.type = ph.type
       AND coalesce(CAST(epoch_ms(bi.t * 1000) AS DATE) >= ph.since, true)
       AND coalesce(CAST(epoch_ms(bi.t * 1000) AS DATE) <= ph.until, true)
      GROUP BY bi.t, bi.source, bi.model
      UNION ALL
      SELECT t, 'claude_code', model, 'emitter_estimate', round(sum(value), 6) FROM inc1h
      WHERE name = 'claude_code_cost_usage_USD_total' GROUP BY t, model""")

    # collector lane
    C = [EV, PTS]
    q["keep_labels"] = with_(C, f"""SELECT event_id, metric, env, {LAB},
      CAST((agent_name <> '')::INT + (decision <> '')::INT + (effort <> '')::INT + (is_git <> '')::INT
           + (model <> '')::INT + (start_type <> '')::INT + (token_type <> '')::INT + (type <> '')::INT
           AS INTEGER) AS n_attrs,
      1 AS n_resource FROM pts""")
    q["contract_filter"] = with_(C, """SELECT metric, temporality, CAST(count(*) AS BIGINT) AS points
      FROM adm GROUP BY ALL""")
    q["upsert_env"] = with_(C, "SELECT 'prod' AS env, CAST(count(*) AS BIGINT) AS points FROM pts")
    q["compact_deltas"] = with_(C, f"SELECT batch_t, metric, env, {LAB}, round(value, 6) AS value FROM sumd")
    q["merge_histograms"] = with_(C, """SELECT batch_t, metric, env, model, token_type,
      CAST(h_count AS BIGINT) AS h_count, round(h_sum, 6) AS h_sum, CAST(b0 AS BIGINT) AS b0,
      CAST(b1 AS BIGINT) AS b1, CAST(b2 AS BIGINT) AS b2 FROM hd""")
    q["bucket_series"] = with_(C, """
      SELECT batch_t, env, token_type, '1000' AS le, CAST(b0 AS BIGINT) AS count FROM hd
      UNION ALL SELECT batch_t, env, token_type, '2000', CAST(b0 + b1 AS BIGINT) FROM hd
      UNION ALL SELECT batch_t, env, token_type, '+Inf', CAST(b0 + b1 + b2 AS BIGINT) FROM hd""")
    q["delta_to_cumulative"] = with_(COLLECT, f"SELECT {lab_out} FROM otlp_samples")
    q["cumulative_stream_restart"] = q["delta_to_cumulative"]
    q["delta_to_cumulative_stream"] = with_(C + [DROWS], f"""SELECT metric, part, env, {LAB}, le,
      round(sum(value), 6) AS value FROM drows GROUP BY ALL""")
    q["series_name"] = with_(A, "SELECT name, CAST(count(*) AS BIGINT) AS samples FROM samples GROUP BY name")
    q["count_events"] = with_([EV], """SELECT (us // 60000000 + 1) * 60 AS batch_t, 'env-' || (user_id % 2) AS env,
      'codex.git.commit.count' AS metric, CAST(count(*) AS BIGINT) AS value
      FROM ev WHERE event_type = 'purchase' GROUP BY ALL""")
    q["identity_leaks"] = with_([EV], """
      SELECT 'resource' AS place, 'service.instance.id' AS key, CAST(count(*) AS BIGINT) AS points FROM ev
      UNION ALL SELECT 'resource', 'user.email', count(*) FROM ev
      UNION ALL SELECT 'attrs', 'session.id', count(*) FROM ev
      UNION ALL SELECT 'attrs', 'user.account_uuid', count(*) FROM ev
      UNION ALL SELECT 'attrs', 'agent_name', count(*) FROM ev WHERE k % 6 = 0""")

    q["identity_values"] = with_([EV], "\n      UNION ALL\n".join(
        f"SELECT '{place}' AS place, '{key}' AS key, CAST(count(*) AS BIGINT) AS points, "
        "CAST(count(DISTINCT user_id) AS BIGINT) AS found FROM ev"
        for place, key in [("resource", "service.instance.id"), ("resource", "user.email"), ("attrs", "session.id"),
                           ("attrs", "user.account_uuid")]))

    # counters and label algebra
    q["increase"] = with_(A, f"SELECT {lab_out} FROM inc1h")
    q["rate_per_hour"] = with_(A, f"""b AS (
        SELECT name, {SLAB}, CAST(ceil(t / 900.0) * 900 AS BIGINT) AS e, sum(step) AS v FROM steps
        WHERE name = 'claude_code_token_usage_tokens_total' GROUP BY ALL),
      f AS (SELECT name, {SLAB}, e + r.k * 900 AS t, v FROM b, (SELECT range AS k FROM range(0, 4)) r)
      SELECT name, {SLAB}, t, round(sum(v) * 1.0, 6) AS value FROM f GROUP BY ALL""")
    q["over_time"] = with_(A, f"""b AS (
        SELECT name, {SLAB}, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS e, min(value) AS mn, max(value) AS mx
        FROM samples GROUP BY ALL),
      f AS (SELECT name, {SLAB}, e + r.k * 3600 AS t, mn, mx FROM b, (SELECT range AS k FROM range(0, 4)) r)
      SELECT name, {SLAB}, t, round(min(mn), 6) AS min_value, round(max(mx), 6) AS max_value
      FROM f GROUP BY ALL""")
    inst = f"""inst_b AS (
        SELECT name, {SLAB}, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS e, max(t) AS last_t, arg_max(value, t) AS value
        FROM samples GROUP BY ALL),
      inst_n AS (
        SELECT *, lead(e) OVER (PARTITION BY name, {SLAB} ORDER BY e) AS nxt, (SELECT max(e) FROM inst_b) AS top FROM inst_b)
      SELECT name, {SLAB}, unnest(generate_series(e, greatest(e, least(coalesce(nxt - 3600, top),
          (last_t + 89999) // 3600 * 3600)), 3600)) + {{off}} AS t, round(value, 6) AS value FROM inst_n"""
    q["instant"] = with_(A, inst.format(off=0))
    q["offset"] = with_(A, inst.format(off=3600))
    q["expire"] = with_(A + [latest(NOW + " - 2 * 86400")], f"SELECT {lab_out} FROM latest")
    q["range_eval"] = with_(A, f"""b AS (
        SELECT name, {SLAB}, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS e, sum(step) AS v FROM steps GROUP BY ALL),
      f AS (SELECT name, {SLAB}, e + r.k * 3600 AS t, v FROM b, (SELECT range AS k FROM range(0, 4)) r),
      g AS (SELECT name, {SLAB}, t, sum(v) AS v FROM f GROUP BY ALL)
      SELECT name, t, round(sum(v), 6) AS value FROM g GROUP BY name, t""")
    grown = f"""cs AS (SELECT *, CAST(ceil(t / 3600.0) * 3600 AS BIGINT) AS e,
                     lag(t) OVER (PARTITION BY name, {SLAB} ORDER BY t) AS prev_t
                   FROM steps WHERE name = 'codex_git_commit_count_total'),
      born AS (SELECT e AS t, floor(sum(CASE WHEN prev_t IS NULL OR t - prev_t > 90000 THEN value ELSE step END) + 0.5) AS value
               FROM cs GROUP BY e)"""
    q["first_batch_growth"] = with_(A, f"""{grown}
      SELECT t, round(value, 6) AS value FROM born""")
    LT = A + [latest(NOW)]
    q["sum_without"] = with_(LT, """SELECT name, env, agent_name, decision, effort, is_git, model, start_type,
      round(sum(value), 6) AS value FROM latest GROUP BY ALL""")
    q["sum_by"] = with_(LT, "SELECT name, env, round(sum(value), 6) AS value FROM latest GROUP BY ALL")
    q["count_by"] = with_(LT, "SELECT name, CAST(count(*) AS DOUBLE) AS value FROM latest GROUP BY name")
    q["match"] = with_(A, f"""SELECT {lab_out} FROM samples
      WHERE name = 'claude_code_token_usage_tokens_total' AND effort <> ''
        AND regexp_full_match(model, 'claude-opus.*') AND NOT regexp_full_match(type, 'cache.*')""")
    q["relabel"] = with_(A, """SELECT 'ai_session_count_total' AS name, 'claude_code' AS source, start_type,
      CAST(count(*) AS BIGINT) AS samples, round(max(value), 6) AS max_value FROM samples
      WHERE name = 'claude_code_session_count_total' GROUP BY start_type""")
    q["recorded_series"] = with_(A, f"""rules AS (SELECT * FROM (VALUES
        ('claude_code_token_usage_tokens_total', 'ai_token_usage_tokens_total', 'claude_code', ''),
        ('claude_code_cost_usage_USD_total', 'ai_cost_usage_usd_total', 'claude_code', 'emitter_estimate'),
        ('claude_code_commit_count_total', 'ai_commit_count_total', 'claude_code', ''),
        ('codex_git_commit_count_total', 'ai_commit_count_total', 'codex', ''),
        ('claude_code_pull_request_count_total', 'ai_pull_request_count_total', 'claude_code', ''),
        ('claude_code_lines_of_code_count_total', 'ai_lines_of_code_count_total', 'claude_code', ''),
        ('claude_code_code_edit_tool_decision_total', 'ai_code_edit_tool_decision_total', 'claude_code', ''),
        ('claude_code_active_time_seconds_total', 'ai_active_time_seconds_total', 'claude_code', ''),
        ('claude_code_session_count_total', 'ai_session_count_total', 'claude_code', '')) AS v(series, recorded, source, cost_kind))
      SELECT recorded AS name, source, cost_kind, {SLAB}, t, round(value, 6) AS value FROM samples JOIN rules ON name = series""")
    q["normalize_model"] = with_(LT, """SELECT name, regexp_replace(model, '\\[1m\\]$', '') AS model,
      round(sum(value), 6) AS value FROM latest GROUP BY ALL""")
    q["label_replace"] = with_(LT, """SELECT CASE WHEN regexp_full_match(model, '([a-z]+)-.*')
        THEN regexp_replace(model, '^(?:([a-z]+)-.*)$', '\\1') ELSE '' END AS family,
      CAST(count(*) AS BIGINT) AS series FROM latest GROUP BY 1""")
    q["compare"] = with_(A, f"SELECT {lab_out} FROM inc1h WHERE value > 1000.0")

    # vector matching
    q["v_sub"] = with_(L, """SELECT a.model, CAST(a.value - b.value AS BIGINT) AS value
      FROM totals a JOIN totals b ON a.model = b.model
      WHERE a.token_type = 'input' AND b.token_type = 'cache_write_input'""")
    q["v_sub_or_zero"] = with_(L, """SELECT a.model, round(CAST(greatest(a.value - coalesce(b.value, 0), 0)
      AS DOUBLE), 6) AS value
      FROM (SELECT * FROM totals WHERE token_type = 'output') a
      LEFT JOIN (SELECT * FROM totals WHERE token_type = 'reasoning_output') b USING (model)""")
    q["v_unless"] = with_(A + [latest(NOW), latest(NOW + " - 7 * 86400", name="early")], f"""
      SELECT name, {SLAB}, round(value, 6) AS value FROM latest l
      WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.name = l.name AND e.env = l.env
        AND e.agent_name = l.agent_name AND e.decision = l.decision AND e.effort = l.effort
        AND e.is_git = l.is_git AND e.model = l.model AND e.start_type = l.start_type
        AND e.token_type = l.token_type AND e.type = l.type AND e.le = l.le)""")
    q["v_and_on"] = with_(A + [claude_hourly("output", "a")], """SELECT t, model, round(value, 6) AS value
      FROM a WHERE t IN (SELECT t FROM inc1h WHERE name = 'codex_git_commit_count_total')""")
    q["v_or"] = with_(A + [claude_hourly("output", "a"), claude_hourly("input", "b")], """
      SELECT t, model, round(value, 6) AS value FROM a
      UNION ALL SELECT t, model, round(value, 6) FROM b
      WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.t = b.t AND a.model = b.model)""")
    q["or_zero"] = with_(A, """num AS (SELECT t, sum(value) AS value FROM inc1h
        WHERE name = 'codex_turn_token_usage_sum' AND token_type = 'total' GROUP BY t),
      grid_t AS (SELECT DISTINCT t FROM hist_long)
      SELECT g.t, round(coalesce(n.value, 0.0), 6) AS value FROM grid_t g LEFT JOIN num n USING (t)""")
    q["v_div"] = with_(A + [claude_hourly("output", "a"), claude_hourly("cacheCreation", "b")], f"""
      SELECT a.t, a.model, round({div('a.value', 'b.value')}, 6) AS ratio FROM a JOIN b USING (t, model)""")
    q["v_div_floor"] = with_(A + [claude_hourly("output", "a"), claude_hourly("cacheCreation", "b")], """
      SELECT a.t, a.model, round(a.value / greatest(b.value, 1.0), 6) AS ratio FROM a JOIN b USING (t, model)""")
    AI = A + [AI_SERIES]
    q["union_sources"] = with_(AI, """SELECT source, type, CAST(count(*) AS BIGINT) AS samples
      FROM ai_series GROUP BY ALL""")

    # panels
    q["capture_ratio"] = with_(A, f"""num AS (SELECT t, sum(value) AS v FROM inc1h
        WHERE name = 'codex_turn_token_usage_sum' AND token_type = 'total' GROUP BY t),
      den AS (SELECT t, sum(value) AS v FROM inc1h
        WHERE name = 'codex_ledger_token_usage_total' AND token_type = 'total' GROUP BY t)
      SELECT d.t, round({div('coalesce(n.v, 0.0)', 'd.v')}, 6) AS ratio FROM den d LEFT JOIN num n USING (t)""")
    q["tokens_by_type"] = with_(AI, "SELECT t, type, round(sum(value), 6) AS tokens FROM ai_inc GROUP BY ALL")
    q["tokens_by_model"] = with_(AI, """SELECT t, regexp_replace(model, '\\[1m\\]$', '') AS model,
      round(sum(value), 6) AS tokens FROM ai_inc GROUP BY ALL""")
    q["tokens_by_effort"] = with_(A, """SELECT t, effort, round(sum(value), 6) AS tokens FROM inc1h
      WHERE name = 'claude_code_token_usage_tokens_total' AND effort <> '' GROUP BY ALL""")
    CL = """cl AS (SELECT * FROM inc1h WHERE name = 'claude_code_token_usage_tokens_total')"""
    q["effort_split"] = with_(A + [CL], """gate AS (SELECT DISTINCT t FROM cl),
      pos AS (SELECT t, effort, sum(value) AS value FROM cl WHERE effort <> '' GROUP BY ALL HAVING sum(value) > 0)
      SELECT t, effort, round(value, 6) AS tokens FROM pos
      UNION ALL SELECT t, 'medium', 0.0 FROM gate g
      WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.t = g.t AND p.effort = 'medium')""")
    q["agent_tokens"] = with_(A + [CL], f"""tot AS (SELECT t, sum(value) AS v FROM cl GROUP BY t),
      by_a AS (SELECT t, agent_name, sum(value) AS v FROM cl WHERE agent_name <> '' GROUP BY ALL)
      SELECT b.t, b.agent_name, round(b.v, 6) AS tokens, round({div('b.v', 'tot.v')}, 6) AS share
      FROM by_a b JOIN tot USING (t)""")
    q["agent_cost"] = with_(A, """SELECT t, agent_name, round(sum(value), 6) AS cost_usd FROM inc1h
      WHERE name = 'claude_code_cost_usage_USD_total' AND agent_name <> '' GROUP BY ALL""")
    q["session_starts"] = with_(A, """SELECT t, round(sum(value), 6) AS sessions FROM inc1h
      WHERE name = 'claude_code_session_count_total' AND start_type <> 'agents_view' GROUP BY t""")
    q["thread_starts"] = with_(A + [THREADS], "SELECT t, round(value, 6) AS threads FROM th_inc")
    q["tokens_per_work_unit"] = with_(AI + [THREADS], """wtok AS (SELECT t, source, sum(value) AS v FROM ai_inc
                                                            GROUP BY ALL),
      den AS (SELECT t, 'claude_code' AS source, sum(value) AS v FROM inc1h
              WHERE name = 'claude_code_session_count_total' AND start_type <> 'agents_view' GROUP BY t
              UNION ALL SELECT t, 'codex', value FROM th_inc)
      SELECT wtok.t, wtok.source, round(wtok.v / greatest(den.v, 1.0), 6) AS tokens_per_unit
      FROM wtok JOIN den USING (t, source)""")
    q["productivity"] = with_(A, grown + """,
      parts AS (
        SELECT t, 'commits' AS metric, 'claude_code' AS split, sum(value) AS value FROM inc1h
        WHERE name = 'claude_code_commit_count_total' GROUP BY t
        UNION ALL SELECT t, 'commits', 'codex', value FROM born
        UNION ALL SELECT t, 'pull_requests', '', sum(value) FROM inc1h
        WHERE name = 'claude_code_pull_request_count_total' GROUP BY t
        UNION ALL SELECT t, 'lines_of_code', type, sum(value) FROM inc1h
        WHERE name = 'claude_code_lines_of_code_count_total' GROUP BY t, type
        UNION ALL SELECT t, 'edit_decisions', decision, sum(value) FROM inc1h
        WHERE name = 'claude_code_code_edit_tool_decision_total' GROUP BY t, decision
        UNION ALL SELECT t, 'active_seconds', type, sum(value) FROM inc1h
        WHERE name = 'claude_code_active_time_seconds_total' GROUP BY t, type)
      SELECT t, metric, split, round(value, 6) AS value FROM parts""")

    # commit lane
    q["pair_tool_calls"] = with_([EV, TOOL_CALLS], "SELECT invocation_id, repo, started, ended FROM calls")
    q["attribute_commits"] = with_([EV, TOOL_CALLS], "SELECT * FROM attributed")
    ids = _hmac_sql(b"meterline-test-key", "repo || chr(0) || sha")
    q["append_commit_events"] = with_([EV, TOOL_CALLS], f"""existing AS (
        SELECT {ids} AS dedupe_id FROM commits
        WHERE committed_at < (SELECT (min(committed_at) + max(committed_at)) // 2 FROM commits)),
      new AS (SELECT {ids} AS dedupe_id, min(committed_at) AS "order"
              FROM attributed GROUP BY 1),
      fresh AS (SELECT * FROM new WHERE dedupe_id NOT IN (SELECT dedupe_id FROM existing))
      SELECT dedupe_id, 'codex.git.commit' AS event, "order" FROM fresh""")
    q["tail_commit_events"] = with_([EV], """SELECT sha256('commit-' || event_id) AS dedupe_id, 'codex.git.commit' AS event
      FROM ev WHERE event_type = 'purchase'""")
    q["commit_dedupe_ids"] = with_([EV, TOOL_CALLS], f"""SELECT repo, sha,
      {_hmac_sql(b"meterline-test-key", "repo || chr(0) || sha")} AS dedupe_id FROM commits""")

    # quality
    q["leak_scan"] = leak_sql()
    for i, (name, said) in enumerate(GAUGES[:5]):
        of = "corpus_shrunk" if name == "corpus_shrunk" else "scan_stats"
        column = "shrunk" if name == "corpus_shrunk" else name
        if said:
            q["exposition_text"] += f" UNION ALL SELECT {4 + 2 * i}, '', 'a', '# HELP codex_ledger_{name} {said}'"
        q["exposition_text"] += f""" UNION ALL SELECT {4 + 2 * i}, '', 'b', '# TYPE codex_ledger_{name} gauge'
          UNION ALL SELECT {5 + 2 * i}, '', '', 'codex_ledger_{name} ' || (SELECT max({column}) FROM ({q[of]}))"""
    return q


def leak_sql() -> str:
    from ..operators.quality import ALLOWED_EMAIL_SUFFIXES, EMAIL_RULE, LEAK_RULES
    parts = []
    for name, pat in LEAK_RULES + [("email", EMAIL_RULE)]:
        p = pat.replace("'", "''")
        parts.append(f"SELECT doc_id AS id, '{name}' AS rule, unnest(regexp_extract_all(text, '{p}')) AS match "
                     f"FROM documents")
    allowed = " OR ".join(f"ends_with(match, '{s}')" for s in ALLOWED_EMAIL_SUFFIXES)
    return ("WITH hits AS (" + " UNION ALL ".join(parts) + ")\n"
            f"SELECT id, rule, match, (rule = 'email' AND ({allowed})) AS allowed FROM hits")
