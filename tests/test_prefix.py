"""The two-level (sliced) scans equal the plain per-key window, including a
hot key holding most rows and slices without any non-null value."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from meterline.functions.prefix import carry_last


def _data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", "c"])
        v = rnd.choice([None, None, None, str(rnd.randint(0, 9))])
        rows.append((k, i * 13 + rnd.randint(0, 5), rnd.randint(1, 9), v))
    return spark.createDataFrame(rows, "k string, t long, x long, v string")


def _collect(df, col):
    return {(r["k"], r["t"]): r[col] for r in df.collect()}


def test_two_level_scans_equal_plain_windows(spark):
    df = _data(spark)
    slice_ = F.floor(F.col("t") / 500)
    assert _collect(carry_last(df, ["k"], ["t"], "v", "c", bucket=slice_), "c") == \
        _collect(carry_last(df, ["k"], ["t"], "v", "c"), "c")
