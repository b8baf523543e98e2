"""Session-ledger sources: discovery (S2), record parsing (S3), changed-file
ingest (S4).

A ledger is a tree of append-only JSONL files under ``sessions/`` (active) and
``archived_sessions/``. Lines are read as text; nothing is inferred.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import carry_last

# The ledger's token fields and the token_type label each maps
# to (input includes cached; output includes reasoning; total = input+output).
TOKEN_FIELDS = [
    ("input_tokens", "input"),
    ("cached_input_tokens", "cached_input"),
    ("cache_write_input_tokens", "cache_write_input"),
    ("output_tokens", "output"),
    ("reasoning_output_tokens", "reasoning_output"),
    ("total_tokens", "total"),
]
TOKEN_TYPES = [t for _, t in TOKEN_FIELDS]
# A line holding neither marker cannot contribute a usage record.
LINE_MARKERS = ['"token_count"', '"turn_context"']

ACTIVE_DIR = "sessions"
ARCHIVED_DIR = "archived_sessions"


# Stands for the lines of a file that cannot be read: a line that is no JSON.
UNREADABLE = LINE_MARKERS[0] + " unreadable"


def _plain(root: str) -> str:
    """A folder's path without scheme and host."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")


def _rel_path(path: Column, root: str) -> Column:
    """Path below the ledger home ``root``, e.g. ``sessions/2024/a.jsonl``."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    home = _plain(root) + "/"
    return F.when(bare.startswith(home), F.substring(bare, len(home) + 1, 1 << 30)).otherwise(bare)


def _decoded(uri: Column) -> Column:
    """``_metadata.file_path`` percent-decodes to the name the listing has."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def read_ledger_lines(spark: SparkSession, root: str) -> DataFrame:
    """Text lines of every ``*.jsonl`` below ``root`` with a stable order key.

    Large files are split by Spark; ``(file_block_start, row id)`` orders the
    lines of one file because ids grow within a split and splits are
    ordered by their start offset.
    """
    df = (spark.read.option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.jsonl")
          .text(root)
          .select("value", "_metadata.file_path", "_metadata.file_block_start")
          .withColumn("_rid", F.monotonically_increasing_id()))
    return df.select(
        _rel_path(_decoded(F.col("file_path")), root).alias("path"),
        F.struct(F.col("file_block_start").alias("block"), F.col("_rid").alias("rid")).alias("ord"),
        F.col("file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def discover_paths(paths: DataFrame) -> DataFrame:
    """S2/D3 on a file list (column ``path``, relative to the ledger home):
    active files, plus archived files whose basename no active file uses.
    Adds ``is_archived``. Works on a listing, so no file is read."""
    files = paths.select("path").distinct() \
        .withColumn("is_archived", F.col("path").startswith(ARCHIVED_DIR + "/")) \
        .withColumn("basename", F.regexp_extract("path", r"([^/]*)$", 1)) \
        .where(F.col("path").startswith(ACTIVE_DIR + "/") | F.col("is_archived"))
    active_names = files.where(~F.col("is_archived")).select("basename").distinct()
    archived_kept = files.where(F.col("is_archived")).join(active_names, "basename", "left_anti")
    return files.where(~F.col("is_archived")).unionByName(archived_kept).drop("basename")


def discover(lines: DataFrame) -> DataFrame:
    """S2/D3 applied to lines: keeps lines of discovered files and adds
    ``is_archived`` and ``path_parts`` (component order for D1)."""
    kept = discover_paths(lines.select("path"))
    return lines.join(kept, "path", "inner").withColumn("path_parts", F.split("path", "/"))


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def usage_records(lines: DataFrame, bucket: Column | None = None) -> DataFrame:
    """S3: ledger lines -> usage records.

    Input columns: ``path``, ``ord`` (orderable within a file), ``line``.
    Output: one row per token_count record with the raw timestamp string,
    the model carried from the file's last preceding turn_context
    ('unknown' before the first), raw dedup-key values (JSON text) and
    cleaned integer counts (P11: non-integers count 0), plus one row per
    parse error (``is_error``) so D2 can count them. Parsing and carrying are
    two steps; a job writes what :func:`parse_lines` gives, so that text is
    read and parsed once."""
    return carry_model(parse_lines(lines), bucket)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Usage records, parse errors and model changes (``ctx_model``) of the
    lines, without the carried model. The VARIANT is narrowed one level per
    projection (record, payload, usage object)."""
    keep = [c for c in lines.columns if c != "line"]
    marked = lines.where(F.col("line").contains(LINE_MARKERS[0]) |
                         F.col("line").contains(LINE_MARKERS[1]))
    # Object tests use the struct cast itself: ``try_variant_get(v, '$',
    # struct<...>)`` is NULL exactly when v is not a JSON object, which is far
    # cheaper than rendering a nested schema string per row.
    s1 = marked.select(*keep, F.try_parse_json("line").alias("_v"))
    s2 = s1.select(*keep, F.try_variant_get("_v", "$", _REC_T).alias("_r"))
    s3 = s2.select(*keep, F.col("_r").isNotNull().alias("_is_obj"),
                   _vtype(F.col("_r.type")).alias("_rt_t"),
                   F.try_variant_get("_r.type", "$", "string").alias("_rt"),
                   _vtype(F.col("_r.timestamp")).alias("_ts_t"),
                   F.try_variant_get("_r.timestamp", "$", "string").alias("_ts"),
                   F.try_variant_get("_r.payload", "$", _PAY_T).alias("_p"))
    s4 = s3.select(*keep, "_is_obj", "_rt_t", "_rt", "_ts_t", "_ts",
                   F.col("_p").isNotNull().alias("_p_obj"),
                   _vtype(F.col("_p.type")).alias("_pt_t"),
                   F.try_variant_get("_p.type", "$", "string").alias("_pt"),
                   _vtype(F.col("_p.model")).alias("_pm_t"),
                   F.try_variant_get("_p.model", "$", "string").alias("_pm"),
                   F.try_variant_get("_p.info", "$", _INFO_T).alias("_i"))
    s5 = s4.select(*keep, "_is_obj", "_rt_t", "_rt", "_ts_t", "_ts", "_p_obj", "_pt_t", "_pt",
                   "_pm_t", "_pm", F.col("_i").isNotNull().alias("_info_obj"),
                   F.try_variant_get("_i.last_token_usage", "$", _USE_T).alias("_us"))

    rtype = F.when(F.col("_rt_t") == "STRING", F.col("_rt"))
    ptype = F.when(F.col("_pt_t") == "STRING", F.col("_pt"))
    kind = (F.when(~F.col("_is_obj"), F.lit("error"))
            .when(~F.col("_p_obj"), F.lit("skip"))
            .when(F.coalesce(rtype == "turn_context", F.lit(False)), F.lit("context"))
            .when(F.coalesce(ptype, F.lit("")) != "token_count", F.lit("skip"))
            .when(~F.col("_info_obj"), F.lit("skip"))
            .when(F.col("_us").isNull(), F.lit("skip"))
            .when(F.coalesce(F.col("_ts_t"), F.lit("")) != "STRING", F.lit("error"))
            .otherwise(F.lit("usage")))
    ctx_model = F.when((F.col("_pm_t") == "STRING") & (F.length("_pm") > 0), F.col("_pm"))
    # A filter on the kind would be pushed below all projections, and every
    # step of the parse repeated in it per use; of an inlined row it is not.
    one = F.struct(kind.alias("_kind"), F.col("_ts").alias("_ts"), F.col("_us").alias("_us"),
                   F.when(kind == "context", ctx_model).alias("ctx_model"))
    classified = s5.select(*keep, F.inline(F.array(one))).where(F.col("_kind") != "skip")
    token_cols = []
    for f, t in TOKEN_FIELDS:
        val = F.col(f"_us.{f}")
        # an absent key and a JSON null are the same key part
        token_cols.append(F.nullif(F.to_json(val), F.lit("null")).alias(f"raw_{t}"))
        token_cols.append(F.when(_vtype(val) == "BIGINT", F.try_variant_get(val, "$", "bigint"))
                          .otherwise(F.lit(0)).alias(t))
    return classified.select(*keep, F.col("_kind").alias("kind"), "ctx_model",
                             F.when(F.col("_kind") == "usage", F.col("_ts")).alias("ts_raw"), *token_cols)


def carry_model(parsed: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Usage records and errors with the model of the file's last preceding
    turn_context. ``bucket`` slices a file for the scan (see
    :mod:`meterline.functions.prefix`); by default the line's ``block`` (file
    split start)."""
    raw = [f"raw_{t}" for t in TOKEN_TYPES]
    own = {"kind", "ctx_model", "ts_raw", *raw, *TOKEN_TYPES}
    keep = [c for c in parsed.columns if c not in own]
    if bucket is None and "block" in parsed.columns:
        bucket = F.col("block")
    carried = carry_last(parsed, ["path"], ["ord"], "ctx_model", "_model", bucket=bucket)
    return carried.where(F.col("kind").isin("usage", "error")).select(
        *keep, (F.col("kind") == "error").alias("is_error"), "ts_raw", F.coalesce("_model", F.lit("unknown")).alias("model"),
        *raw, *TOKEN_TYPES)


_REC_T = "struct<type:variant,timestamp:variant,payload:variant>"
_PAY_T = "struct<type:variant,model:variant,info:variant>"
_INFO_T = "struct<last_token_usage:variant>"
_USE_T = "struct<" + ",".join(f"{f}:variant" for f, _ in TOKEN_FIELDS) + ">"


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Ledger file listing (file_path, path, length, modificationTime) without
    reading file contents (``binaryFile`` with only metadata columns)."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.jsonl")
            .load(root)
            .select(F.col("path").alias("file_path"), _rel_path(F.col("path"), root).alias("path"), "length", "modificationTime"))


def _read_ranges(batches, keep):
    """Lines of byte ranges (file_path, from, to, length, ...); the last line
    of a file counts without a line feed, too."""
    import pyarrow as pa

    from .tail import lines_of, open_file

    for batch in batches:
        for row in batch.to_pylist():
            at, text, size = [], [], 0

            def found():
                n = len(at)
                same = [pa.array([row[c]] * n, batch.schema.field(c).type) for c in keep]
                return pa.RecordBatch.from_arrays([*same, pa.array([row["from"]] * n, pa.int64()), pa.array(at, pa.int64()),
                                                   pa.array(text, pa.string())], [*keep, "block", "ord", "line"])

            try:
                with open_file(row["file_path"]) as f:
                    for offset, line in lines_of(f, row["from"], row["to"], last=row["to"] == row["length"]):
                        at.append(offset)
                        text.append(line.decode("utf-8", "replace"))
                        size += len(line)
                        if size >= 4 << 20:
                            yield found()
                            at, text, size = [], [], 0
            except OSError:  # an unreadable file is one error of the scan, not its end
                if row["from"] == 0:
                    at.append(0)
                    text.append(UNREADABLE)
            if at:
                yield found()


def read_files(files: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """Lines of the listed files (``file_path``, ``length`` and further
    columns, which are kept): tasks open byte ranges, and the list stays a
    DataFrame, however many files have changed. Adds ``block``, ``ord`` (the
    offset) and ``line``."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    parts = files.where("length > 0").withColumn("from", F.explode(starts))
    parts = parts.withColumn("to", F.least(F.col("from") + range_bytes, F.col("length"))).repartition("file_path", "from")
    keep = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("block", T.LongType()), T.StructField("ord", T.LongType()),
                           T.StructField("line", T.StringType())])
    return parts.mapInArrow(lambda it: _read_ranges(it, keep), schema)


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """S2 on the listing: the files a scan reads, with ``is_archived`` and
    ``path_parts``."""
    listing = file_listing(spark, root)
    return listing.join(discover_paths(listing.select("path")), "path").withColumn("path_parts", F.split("path", "/"))


def ingest_changed(spark: SparkSession, root: str, manifest: DataFrame | None,
                   cached_records: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Re-parse only new or changed files (by size and modification
    time); forget vanished files and files discovery now drops.

    ``manifest`` is the previous listing (file_path, length,
    modificationTime); ``cached_records`` the previous output (records with
    a ``file_path`` column). Returns (new manifest, records). The listing
    reads no file contents, and file names stay in DataFrames.
    :mod:`meterline.sources.incremental` keeps both in a folder.
    """
    listing = discovered(spark, root)
    same = ["file_path", "length", "modificationTime"]
    changed = listing if manifest is None else listing.join(manifest.select(*same), same, "left_anti")
    fresh = usage_records(read_files(changed.drop("modificationTime"))).drop("length")
    if manifest is not None and cached_records is not None:
        unchanged = listing.join(manifest.select(*same), same, "left_semi")
        fresh = cached_records.join(unchanged.select("file_path"), "file_path", "left_semi").unionByName(fresh)
    return listing.select(*same), fresh
