"""The ledger exporter as a job: one scan, and the text it serves.

Each scan brings the kept state (:mod:`meterline.sources.incremental`) up to
date and adds one row to its ``scans`` table: what D2 counts, when the scan
ended, how long it took and whether any total has ever fallen between two
scans. If a scan fails, the figures of the last good one are served with
``scan_ok`` 0; a single file that cannot be read is one parse error of a good
scan.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators.dedup import scan_stats
from ..sinks.text import exposition_text
from ..sources.incremental import LedgerState

LOG = logging.getLogger(__name__)


def has_shrunk(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row, ``corpus_shrunk``: 1 if a total of ``before`` is larger than
    ``now`` has it (an absent one is 0)."""
    keys = ["model", "token_type"]
    both = before.join(now.withColumnRenamed("value", "_now"), keys, "left")
    return both.agg(F.coalesce(F.max((F.coalesce("_now", F.lit(0)) < F.col("value")).cast("int")), F.lit(0)).alias("corpus_shrunk"))


def _scan(state: LedgerState, root: str) -> None:
    started = time.monotonic()
    version = state.scan(root)
    stats = scan_stats(state.records(version), state.kept(version), state.manifest(version))
    shrunk = F.lit(0)
    if version > 1:
        fallen = has_shrunk(A.ledger_totals(state.kept(version - 1)), A.ledger_totals(state.kept(version)))
        earlier = state.scans().agg(F.coalesce(F.max("corpus_shrunk"), F.lit(0)))
        shrunk = F.greatest(fallen.scalar(), earlier.scalar())
    row = stats.withColumn("corpus_shrunk", shrunk.cast("int"))
    row = row.withColumn("last_scan_timestamp_seconds", F.lit(time.time())).withColumn(
        "scan_duration_seconds", F.lit(time.monotonic() - started))
    state.add_scan(version, row)


def scan_and_expose(spark: SparkSession, root: str, folder: str, env: str) -> DataFrame:
    """K1 after a scan: the lines of all series and of all seven gauges."""
    state, ok = LedgerState(spark, folder), 1
    try:
        _scan(state, root)
    except Exception:  # whatever it was, the last good figures are served
        LOG.exception("the scan of %s failed", root)
        ok = 0
    version = state.last_scan()
    if not version:
        nothing = spark.range(0).select(F.lit("").alias("model"), F.lit("").alias("token_type"), F.lit(0).alias("value"), F.lit(0).alias("records"))
        return exposition_text(nothing, nothing, env, spark.range(1).select(F.lit(ok).alias("scan_ok")))
    kept = state.kept(version)
    stats = state.scans().where(F.col("version") == version).withColumn("scan_ok", F.lit(ok))
    return exposition_text(A.ledger_totals(kept), A.turn_records(kept), env, stats)
