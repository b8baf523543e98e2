"""Skew-safe ordered carry-forward per key.

A window ``partitionBy(key).orderBy(t)`` puts a whole key in one task; one
hot file (a third of all lines) would then be one task. :func:`carry_last`
scans in two levels instead:

1. the key is split into ``(key, slice)`` where ``slice`` is a coarse,
   order-monotone function of the ordering (for example a file split); the
   in-slice scan is a window over the slice, the only shuffle of all rows;
2. each slice's last value is an aggregate, combined map-side, so one row per
   slice is shuffled; these are scanned per key, a window over ``#slices``
   rows, and joined back on ``(key, slice)``.

The two levels read their input once each, the second only its key, order and
value: pass a table that is written, not one that is costly to compute.

Keys must be non-null (label columns use ``''`` for absent labels). With
``bucket=None`` the plain single-level window is used (for groups whose size
is bounded by construction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__px_slice"
_ORD = "__px_ord"


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sliced(df: DataFrame, bucket: Column, order) -> DataFrame:
    return df.withColumn(_B, bucket).withColumn(_ORD, F.struct(*_order(order)))


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               value: str | Column, out: str, bucket: Column | None = None) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per key."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*_order(order)) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    sliced = _sliced(df, bucket, order).withColumn("__px_value", value)
    w_in = Window.partitionBy(*keys, _B).orderBy(_ORD).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    win = sliced.withColumn("__px_within", F.last("__px_value", ignorenulls=True).over(w_in)).drop("__px_value")
    # max_by leaves out rows without an order; a slice without a value keeps a row.
    lasts = sliced.groupBy(*keys, _B).agg(F.max_by("__px_value", F.when(F.col("__px_value").isNotNull(), F.col(_ORD))).alias("__px_last"))
    w_prev = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, _B, F.last("__px_last", ignorenulls=True).over(w_prev)
                           .alias("__px_carried"))
    joined = win.join(carried, on=[*keys, _B], how="inner")
    return joined.withColumn(out, F.coalesce("__px_within", "__px_carried")) \
        .drop(_B, _ORD, "__px_within", "__px_carried")
