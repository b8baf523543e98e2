"""Scalar semantics: PromQL rounding, clamp_min with NaN, IEEE division,
label escaping order, anchored regex, label_replace on a constant vector."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meterline.functions import scalars as S
from meterline.operators.labels import label_replace, match


def one(spark, expr, schema="x double", rows=((0.0,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("v")).collect()


def test_round_ties_up_like_promql(spark):
    got = [r["v"] for r in one(spark, S.prom_round(F.col("x")), rows=[(-2.5,), (2.5,), (0.49,)])]
    assert got == [-2.0, 3.0, 0.0]


def test_clamp_min_keeps_nan(spark):
    got = [r["v"] for r in one(spark, S.clamp_min(F.col("x"), 0.0), rows=[(float("nan"),), (-1.0,), (2.0,)])]
    assert math.isnan(got[0]) and got[1:] == [0.0, 2.0]


def test_division_follows_ieee(spark):
    rows = [(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 4.0)]
    got = [r["v"] for r in one(spark, S.prom_div("a", "b"), "a double, b double", rows)]
    assert math.isnan(got[0]) and got[1:] == [float("inf"), float("-inf"), 0.25]


def test_label_escaping_order(spark):
    got = one(spark, S.escape_label(F.col("s")), "s string", [('a\\b"c\nd',)])[0]["v"]
    assert got == 'a\\\\b\\"c\\nd'
    back = one(spark, S.unescape_label(F.lit(got)), "s string", [("",)])[0]["v"]
    assert back == 'a\\b"c\nd'


def test_anchored_matchers_treat_absent_as_empty(spark):
    df = spark.createDataFrame([("claude-opus-4", ""), ("xclaude-opus", "high")], "model string, effort string")
    assert [r["model"] for r in match(df, re={"model": "claude-opus.*"}).collect()] == ["claude-opus-4"]
    assert [r["model"] for r in match(df, eq={"effort": ""}).collect()] == ["claude-opus-4"]
    assert match(df, eq={"missing": ""}).count() == 2


def test_label_replace_creates_label_on_constant_vector(spark):
    vec = spark.createDataFrame([(0.0,)], "value double")
    out = label_replace(vec, "effort", "medium", "", "").collect()
    assert out[0]["effort"] == "medium" and out[0]["value"] == 0.0
    df = spark.createDataFrame([("gpt-5.5",), ("plain",)], "model string")
    got = {r["model"]: r["family"] for r in label_replace(df, "family", "$1", "model", "([a-z]+)-.*").collect()}
    assert got == {"gpt-5.5": "gpt", "plain": ""}


def test_sha_prefix_joins_with_nul_and_null_as_empty(spark):
    import hashlib
    got = one(spark, S.sha256_prefix(F.col("a"), F.col("b")), "a string, b string", [("x", None)])[0]["v"]
    assert got == hashlib.sha256(b"x\0").hexdigest()[:24]
