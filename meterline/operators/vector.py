"""PromQL vector matching as joins.

Vectors are DataFrames of label columns plus ``value`` (and optionally
``t`` when evaluated over a range; include it in ``on``). Absence is a
missing row, never a NULL or a zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import carry_last
from ..functions.scalars import clamp_min, prom_div
from ..session import bounded_broadcast


def _rv(df: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    return df.select(*on, F.col("value").alias(name))


def v_sub(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """J1 ``a - on(...) b``: one-to-one; unmatched rows vanish."""
    j = _rv(a, on, "_a").join(_rv(b, on, "_b"), list(on), "inner")
    return j.select(*on, (F.col("_a") - F.col("_b")).alias("value"))


def v_sub_or_zero(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """J2 ``clamp_min(a - (b or a*0), 0)``: a missing subtrahend is 0."""
    j = _rv(a, on, "_a").join(_rv(b, on, "_b"), list(on), "left")
    return j.select(*on, clamp_min(F.col("_a") - F.coalesce("_b", F.lit(0.0)), 0.0)
                    .cast("double").alias("value"))


def price_join(usage: DataFrame, prices: DataFrame,
               on: Sequence[str] = ("source", "model", "type"),
               price_col: str = "usd_per_token") -> DataFrame:
    """J3 ``usage * on(...) group_left prices``: many-to-one multiply with
    the provider pinned on both sides. The price side is a dimension whose
    size is checked before it is broadcast."""
    p = bounded_broadcast(prices.select(*on, price_col))
    return usage.join(p, list(on), "inner")


def v_unless(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """J4 ``a unless on(...) b``."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def v_and_on(a: DataFrame, b: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """J5 ``a and on(...) b``; with ``on=()`` a survives iff b is non-empty
    (an EXISTS subquery)."""
    if on:
        return a.join(b.select(*on).distinct(), list(on), "left_semi")
    return a.where(b.exists())


def v_or(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """J6 ``a or b``: a, plus rows of b whose labels a lacks."""
    return a.unionByName(b.join(a.select(*on).distinct(), list(on), "left_anti"),
                         allowMissingColumns=True)


def or_zero(v: DataFrame, grid: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """J7 ``x or vector(0)``: where x is empty the result is 0. With a
    ``grid`` of evaluation points (e.g. ``t``), per grid row."""
    if grid is None:
        total = v.agg(F.sum("value")).scalar()
        return v.sparkSession.range(1).select(F.coalesce(total, F.lit(0.0)).alias("value"))
    g = list(grid.columns)
    return grid.join(v, g, "left").select(*g, *[k for k in keys if k not in g],
                                          F.coalesce("value", F.lit(0.0)).alias("value"))


def v_div(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """J8 ``a / b``: IEEE results (0/0 NaN, x/0 Inf); no b row -> no row."""
    j = _rv(a, on, "_a").join(_rv(b, on, "_b"), list(on), "inner")
    return j.select(*on, prom_div("_a", "_b").alias("value"))


def v_div_floor(a: DataFrame, b: DataFrame, on: Sequence[str], m: float = 1.0) -> DataFrame:
    """J9 ``a / clamp_min(b, m)``."""
    j = _rv(a, on, "_a").join(_rv(b, on, "_b"), list(on), "inner")
    return j.select(*on, (F.col("_a") / clamp_min("_b", m)).alias("value"))


def union_sources(*dfs: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Rule outputs with one name and different ``source`` form one
    series family; labels a rule does not carry are ''."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    fill = [c for c in labels if c in out.columns]
    return out.na.fill("", subset=fill) if fill else out


#: Order of what happens at one time: a price ends, a price starts, it is used.
_ENDS, _STARTS, _USED = 0, 1, 2
_OPEN = -(1 << 40)  # when a price without a start began
_SLICE = 86_400     # seconds of a slice of the merged stream


def _midnight(date) -> F.Column:
    return F.unix_date(date).cast("bigint") * 86_400


def price_changes(prices: DataFrame, on: Sequence[str], price_col: str) -> DataFrame:
    """(on..., _t, _what, _price): when each price starts and ends to hold.
    ``effective_from`` and ``effective_to`` are dates, inclusive, open where
    null; ``_price`` is a struct, null inside once a price has ended."""
    start = F.struct(F.coalesce(_midnight(F.col("effective_from")), F.lit(_OPEN)).alias("_t"), F.lit(_STARTS).alias("_what"),
                     F.struct(F.col(price_col).alias("p")).alias("_price"))
    end = F.when(F.col("effective_to").isNotNull(), F.struct(
        (_midnight(F.col("effective_to")) + 86_400).alias("_t"), F.lit(_ENDS).alias("_what"),
        F.struct(F.lit(None).cast(prices.schema[price_col].dataType).alias("p")).alias("_price")))
    return prices.select(*on, F.inline(F.filter(F.array(start, end), lambda x: x.isNotNull())))


def price_at(usage: DataFrame, prices: DataFrame,
             on: Sequence[str] = ("source", "model", "type"),
             price_col: str = "usd_per_token", t_col: str = "t", mode: str = "step", at: int | None = None) -> DataFrame:
    """Usage rows with the price in effect; rows without one vanish.

    ``mode="step"`` takes the price at each row's time: usage and price
    changes are merged into one stream per key in time order and the last
    price is carried (a union and a skew-safe scan, sliced by day; no range
    predicate, and neither side has to be small). ``mode="instant"`` takes the
    price at the evaluation time ``at`` (unix seconds) for all rows. Validity
    ranges of one key must not overlap, as manifests guarantee.
    """
    on = list(on)
    if mode == "instant":
        day = F.lit(at // 86_400).cast("bigint")
        valid = prices.where(F.coalesce(F.unix_date("effective_from") <= day, F.lit(True)) &
                             F.coalesce(F.unix_date("effective_to") >= day, F.lit(True)))
        return price_join(usage, valid, on, price_col).select(*usage.columns, price_col)
    if mode != "step":
        raise ValueError(f"mode must be step or instant, got {mode}")
    changes = price_changes(prices, on, price_col)
    row = F.struct(*[F.col(c) for c in usage.columns])
    used = usage.select(*on, F.col(t_col).cast("bigint").alias("_t"), F.lit(_USED).alias("_what"), row.alias("_row"))
    merged = used.unionByName(changes, allowMissingColumns=True)
    carried = carry_last(merged, on, ["_t", "_what"], "_price", "_now", bucket=F.floor(F.col("_t") / _SLICE))
    return carried.where(F.col("_row").isNotNull() & F.col("_now.p").isNotNull()).select("_row.*", F.col("_now.p").alias(price_col))
