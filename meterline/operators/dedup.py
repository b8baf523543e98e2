"""Deduplication: fork/replay dedup (D1), scan statistics (D2) and commit
dedupe ids (D4). Active-over-archive (D3) lives in
:func:`meterline.sources.ledger.discover`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hmac_sha256_hex
from ..sources.ledger import TOKEN_TYPES

KEY_COLS = ["ts_raw"] + [f"raw_{t}" for t in TOKEN_TYPES]


def dedup_replays(records: DataFrame) -> DataFrame:
    """One record per (raw timestamp, six raw token values); the first
    in discovery order wins (active before archived, then path components,
    then line order), which decides the kept record's model.

    Expressed as a grouped ``min`` over an ordering struct rather than a
    ``row_number`` window: the aggregate is combined map-side, so a record
    replayed into many files (a hot key) never gathers in one task.
    Grouping treats NULL key parts as equal, like Python tuple equality.
    """
    usage = records.where(~F.col("is_error"))
    payload_cols = [c for c in usage.columns if c not in KEY_COLS]
    first = F.min(F.struct(
        F.col("is_archived"), F.col("path_parts"), F.col("ord"),
        F.struct(*[F.col(c) for c in payload_cols]).alias("rec")))
    kept = usage.groupBy(*KEY_COLS).agg(first.alias("_w"), F.count("*").alias("copies"))
    return kept.select(*KEY_COLS, "copies", "_w.rec.*")


def scan_stats(records: DataFrame, kept: DataFrame, files: DataFrame | None = None, ok: bool = True) -> DataFrame:
    """Files scanned, parse errors, duplicates removed, kept records and
    the ok flag, as one aggregate over records plus kept-record markers.
    ``files`` is the listing (``path``): files without any usage or error
    line are scanned, too. ``ok`` is false where these are the figures of an
    earlier scan because the last one failed."""
    r = records.select("path", "is_error", F.lit(False).alias("_kept"))
    k = kept.select(F.lit(None).cast("string").alias("path"), F.lit(False).alias("is_error"),
                    F.lit(True).alias("_kept"))
    u = r.unionByName(k)
    if files is not None:
        u = u.unionByName(files.select("path", F.lit(None).cast("boolean").alias("is_error"), F.lit(False).alias("_kept")))
    n_kept = F.sum(F.col("_kept").cast("bigint"))
    n_usage = F.sum((~F.col("_kept") & ~F.col("is_error")).cast("bigint"))
    return u.agg(
        F.count_distinct("path").cast("bigint").alias("files_scanned"),
        F.sum((~F.col("_kept") & F.col("is_error")).cast("bigint")).cast("bigint").alias("parse_errors"),
        (n_usage - n_kept).cast("bigint").alias("duplicate_records"),
        n_kept.cast("bigint").alias("records_kept"),
        F.lit(int(ok)).cast("int").alias("scan_ok"))


def commit_dedupe_ids(commits: DataFrame, secret: bytes, repo_col: str = "repo",
                      sha_col: str = "sha") -> DataFrame:
    """``dedupe_id`` = HMAC-SHA256(secret, repo + NUL + sha) in hex."""
    msg = F.concat_ws("\u0000", F.col(repo_col), F.col(sha_col))
    return commits.withColumn("dedupe_id", hmac_sha256_hex(secret, msg, commits.sparkSession))
