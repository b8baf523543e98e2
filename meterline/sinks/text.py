"""Text sinks: Prometheus exposition (K1) and OpenMetrics history (K2).

Both return a DataFrame of lines with their sort columns; writing is an
``orderBy`` on those columns followed by ``write.text`` (a distributed
range sort, no driver-side assembly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_label

# Backfill target labels (the live scrape's job and instance)
# and the category order of the history file.
DEFAULT_JOB = "codex-ledger"
DEFAULT_INSTANCE = "host.docker.internal:9314"
CATEGORY_ORDER = ["input", "cacheRead", "cacheCreation", "output", "reasoning_output"]
TOKEN_ORDER = ["input", "cached_input", "cache_write_input", "output", "reasoning_output", "total"]

TOKENS_METRIC = "codex_ledger_token_usage_total"
TURNS_METRIC = "codex_ledger_turn_records_total"
SCAN_METRIC = "codex_ledger_"
# The scan's gauges in their order, and what they say.
GAUGES = [
    ("scan_ok", "Whether the last scan of the ledger succeeded (1) or not (0)."),
    ("parse_errors", "Lines of the ledger that do not parse at present."),
    ("duplicate_records", "Replayed copies left out of the totals."),
    ("corpus_shrunk", "1 once a total fell between two scans."),
    ("files_scanned", None),
    ("last_scan_timestamp_seconds", None),
    ("scan_duration_seconds", None),
]


def _lab(name: str, value) -> F.Column:
    return F.concat(F.lit(f'{name}="'), escape_label(value), F.lit('"'))


def exposition_text(totals: DataFrame, turns: DataFrame, env: str,
                    stats: DataFrame | None = None) -> DataFrame:
    """K1: exposition lines (section, model, token_type, line). Series are
    sorted by (model, token_type); HELP/TYPE lines head each section.
    ``stats`` is one row with those of the ``GAUGES`` that the scan knows;
    the two in seconds are written with three decimals."""
    env_l = F.concat(F.lit('env="'), escape_label(F.lit(env)), F.lit('",'))
    tok = totals.select(
        F.lit(1).alias("section"), "model", "token_type",
        F.concat(F.lit(TOKENS_METRIC + "{"), env_l, _lab("model", F.col("model")), F.lit(","),
                 _lab("token_type", F.col("token_type")), F.lit("} "), F.col("value").cast("string"))
        .alias("line"))
    trn = turns.select(
        F.lit(3).alias("section"), "model", F.lit("").alias("token_type"),
        F.concat(F.lit(TURNS_METRIC + "{"), env_l, _lab("model", F.col("model")), F.lit("} "),
                 F.col("records").cast("string")).alias("line"))
    spark = totals.sparkSession
    heads = spark.createDataFrame([
        (0, "", "a", f"# HELP {TOKENS_METRIC} Ledger tokens by model and token_type, replay-deduplicated."),
        (0, "", "b", f"# TYPE {TOKENS_METRIC} counter"),
        (2, "", "a", f"# HELP {TURNS_METRIC} Deduplicated token_count records by model."),
        (2, "", "b", f"# TYPE {TURNS_METRIC} counter"),
    ], "section int, model string, token_type string, line string")
    out = heads.unionByName(tok).unionByName(trn)
    if stats is not None:
        def row(section: int, order: str, line):
            return F.struct(F.lit(section).alias("section"), F.lit("").alias("model"),
                            F.lit(order).alias("token_type"), line.alias("line"))

        rows = []
        for i, (name, said) in enumerate(GAUGES):
            if name not in stats.columns:
                continue
            metric = SCAN_METRIC + name
            value = F.col(name).cast("string")
            if name.endswith("_seconds"):
                value = F.format_string("%.3f", F.col(name).cast("double"))
            if said:
                rows.append(row(4 + 2 * i, "a", F.lit(f"# HELP {metric} {said}")))
            rows += [row(4 + 2 * i, "b", F.lit(f"# TYPE {metric} gauge")),
                     row(5 + 2 * i, "", F.concat(F.lit(metric + " "), value))]
        out = out.unionByName(stats.select(F.inline(F.array(*rows))))
    return out


def openmetrics_history(categories: DataFrame, env: str, job: str = DEFAULT_JOB,
                        instance: str = DEFAULT_INSTANCE, raw: bool = False) -> DataFrame:
    """K2: hourly cumulative samples (t, model, pos, line) in hour, model,
    category order; the file ends with ``# EOF`` (pos = -1, after all)."""
    static = F.concat(_lab("env", F.lit(env)), F.lit(","), _lab("instance", F.lit(instance)),
                      F.lit(","), _lab("job", F.lit(job)))
    if raw:
        order, metric, tcol, extra = TOKEN_ORDER, TOKENS_METRIC, "token_type", F.lit("")
    else:
        order, metric, tcol, extra = CATEGORY_ORDER, "ai_token_usage_tokens_total", "type", \
            F.lit(',source="codex"')
    pos = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(tcol)).cast("int")
    line = F.concat(F.lit(metric + "{"), static, F.lit(","), _lab("model", F.col("model")), extra,
                    F.lit(f',{tcol}="'), F.col(tcol), F.lit('"} '), F.col("value").cast("string"),
                    F.lit(" "), F.col("t").cast("string"))
    body = categories.select("t", "model", pos.alias("pos"), line.alias("line"))
    eof = categories.sparkSession.createDataFrame([(None, None, None, "# EOF")],
                                                  "t bigint, model string, pos int, line string")
    return body.unionByName(eof)


def write_ordered(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write lines in ``order``: a global range sort, one part file per
    range, so the part files concatenated in name order are the document
    (no single task holds the whole file). NULL sort keys go last, which
    places ``# EOF`` at the end."""
    lines.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select("line") \
        .write.mode("overwrite").text(path)
