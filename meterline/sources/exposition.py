"""Prometheus text exposition snapshots (S7) read as samples.

Re-aimed from the live scrape: snapshots are text files, each line parsed
with built-in regex functions; target labels ``job`` and ``instance`` are
attached as a scrape would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unescape_label

# Exposition sample line and label pair grammar.
SAMPLE_LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$'
LABEL_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse_exposition(lines: DataFrame, job: str, instance: str, line_col: str = "value") -> DataFrame:
    """Lines -> (name, labels map, value, ts) for sample lines; comments
    (``# HELP``, ``# TYPE``, ``# EOF``) and blanks are skipped."""
    ln = F.col(line_col)
    body = lines.where(~ln.startswith("#") & (F.length(F.trim(ln)) > 0) & ln.rlike(SAMPLE_LINE))
    lab = F.regexp_extract(ln, SAMPLE_LINE, 2)
    keys = F.regexp_extract_all(lab, F.lit(LABEL_PAIR), 1)
    vals = F.transform(F.regexp_extract_all(lab, F.lit(LABEL_PAIR), 2), lambda v: unescape_label(v))
    scraped = F.map_filter(F.map_from_arrays(keys, vals), lambda k, v: ~k.isin("job", "instance"))
    labels = F.map_concat(scraped,
                          F.create_map(F.lit("job"), F.lit(job), F.lit("instance"), F.lit(instance)))
    ts = F.regexp_extract(ln, SAMPLE_LINE, 4)
    return body.select(
        F.regexp_extract(ln, SAMPLE_LINE, 1).alias("name"),
        labels.alias("labels"),
        F.regexp_extract(ln, SAMPLE_LINE, 3).try_cast("double").alias("value"),
        F.when(ts != "", ts.cast("bigint")).alias("ts"))


def read_exposition(spark: SparkSession, path: str, job: str, instance: str) -> DataFrame:
    """Exposition text files -> samples with target labels."""
    return parse_exposition(spark.read.text(path), job, instance)
