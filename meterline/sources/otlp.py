"""OTLP metric payloads as JSON (S1): explicit schema, flattened to one row
per data point with the same columns as the collector jobs consume.

An attribute's value is read as VARIANT, whatever its type is, and becomes
text as an exporter shows it: strings as they are, booleans and numbers by
their JSON text, lists, maps and bytes as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KV = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.VariantType()),
]))
_SUM_POINT = T.StructType([
    T.StructField("attributes", _KV),
    T.StructField("startTimeUnixNano", T.StringType()),
    T.StructField("timeUnixNano", T.StringType()),
    T.StructField("asInt", T.StringType()),
    T.StructField("asDouble", T.DoubleType()),
])
_HIST_POINT = T.StructType([
    T.StructField("attributes", _KV),
    T.StructField("startTimeUnixNano", T.StringType()),
    T.StructField("timeUnixNano", T.StringType()),
    T.StructField("count", T.StringType()),
    T.StructField("sum", T.DoubleType()),
    T.StructField("bucketCounts", T.ArrayType(T.StringType())),
    T.StructField("explicitBounds", T.ArrayType(T.DoubleType())),
])
_METRIC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("sum", T.StructType([
        T.StructField("aggregationTemporality", T.IntegerType()),
        T.StructField("isMonotonic", T.BooleanType()),
        T.StructField("dataPoints", T.ArrayType(_SUM_POINT)),
    ])),
    T.StructField("histogram", T.StructType([
        T.StructField("aggregationTemporality", T.IntegerType()),
        T.StructField("dataPoints", T.ArrayType(_HIST_POINT)),
    ])),
])
OTLP_SCHEMA = T.StructType([T.StructField("resourceMetrics", T.ArrayType(T.StructType([
    T.StructField("resource", T.StructType([T.StructField("attributes", _KV)])),
    T.StructField("scopeMetrics", T.ArrayType(T.StructType([
        T.StructField("scope", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("version", T.StringType()),
            T.StructField("attributes", _KV),
        ])),
        T.StructField("metrics", T.ArrayType(_METRIC)),
    ]))),
])))])


# The fields of an OTLP value of one JSON token, and of those of many.
_PLAIN = ["stringValue", "boolValue", "intValue", "doubleValue", "bytesValue"]
_NESTED = ["arrayValue.values", "kvlistValue.values"]


def _text(value) -> F.Column:
    """An OTLP value of any type as text; null for one without a value."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{f}", "string") for f in _PLAIN],
                      *[F.to_json(F.try_variant_get(value, f"$.{f}", "variant")) for f in _NESTED])


def _attrs(col) -> F.Column:
    """Attributes as a string map; of a repeated key the last one counts."""
    some = F.coalesce(col, F.array().cast(_KV))
    pairs = F.filter(F.transform(some, lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("value"), _text(a["value"]))),
                     lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def read_otlp_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """S1 source: OTLP JSON documents (one per file when ``multiline``)."""
    return spark.read.schema(OTLP_SCHEMA).option("multiLine", multiline).json(path)


def flatten_otlp(df: DataFrame) -> DataFrame:
    """Resource -> scope -> metric -> data point, one row per point of
    either kind, in one projection.

    Columns: resource, scope_name, scope_version, scope_attrs, metric, kind,
    temporality, monotonic, attrs, start_ns, time_ns, value, h_count, h_sum,
    bucket_counts, bounds. Attributes become string maps; nanosecond times
    are BIGINT (Spark timestamps stop at microseconds).
    """
    rm = df.select(F.explode("resourceMetrics").alias("rm"))
    sm = rm.select(_attrs(F.col("rm.resource.attributes")).alias("resource"),
                   F.explode("rm.scopeMetrics").alias("sm"))
    m = sm.select("resource", F.col("sm.scope.name").alias("scope_name"),
                  F.col("sm.scope.version").alias("scope_version"),
                  _attrs(F.col("sm.scope.attributes")).alias("scope_attrs"),
                  F.explode("sm.metrics").alias("m"))

    def point(p, kind, temporality, monotonic, value=None, count=None, total=None, buckets=None, bounds=None):
        none = F.lit(None)
        fields = {"kind": F.lit(kind), "temporality": temporality, "monotonic": monotonic, "attributes": p["attributes"],
                  "start_ns": p["startTimeUnixNano"].cast("bigint"), "time_ns": p["timeUnixNano"].cast("bigint"),
                  "value": (none if value is None else value).cast("double"),
                  "h_count": (none if count is None else count).cast("bigint"),
                  "h_sum": (none if total is None else total).cast("double"),
                  "bucket_counts": (none if buckets is None else buckets).cast("array<bigint>"),
                  "bounds": (none if bounds is None else bounds).cast("array<double>")}
        return F.named_struct(*[x for name, field in fields.items() for x in (F.lit(name), field)])

    sums = F.transform("m.sum.dataPoints", lambda p: point(
        p, "sum", F.col("m.sum.aggregationTemporality"), F.col("m.sum.isMonotonic"),
        value=F.coalesce(p["asInt"].cast("double"), p["asDouble"])))
    hists = F.transform("m.histogram.dataPoints", lambda p: point(
        p, "histogram", F.col("m.histogram.aggregationTemporality"), F.lit(True),
        count=p["count"], total=p["sum"], buckets=p["bucketCounts"], bounds=p["explicitBounds"]))
    points = F.flatten(F.filter(F.array(sums, hists), lambda x: x.isNotNull()))
    flat = m.select("resource", "scope_name", "scope_version", "scope_attrs", F.col("m.name").alias("metric"), F.inline(points))
    return flat.select("resource", "scope_name", "scope_version", "scope_attrs", "metric", "kind", "temporality", "monotonic",
                       _attrs(F.col("attributes")).alias("attrs"), "start_ns", "time_ns", "value", "h_count", "h_sum", "bucket_counts", "bounds")
