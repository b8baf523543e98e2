"""Counter and time-series operators.

A sample table has label columns, ``t`` (unix seconds, BIGINT) and
``value`` (DOUBLE). Series identity is every column except ``t`` and
``value`` unless ``keys`` is given. Series here are compacted: at most one
sample per series and scrape / arrival batch (A3 pre-aggregates raw points
map-side first), so an ordered window per series is bounded by the time
span, not by data volume; range evaluation is bucketed aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import prom_round

DAY = 86_400
HOUR = 3_600
# A stream idle this long restarts (T1); an exported series
# without update this long vanishes (T3). Expiry must exceed staleness so a
# stream cannot vanish and reappear carrying its old cumulative history.
MAX_STALE = 24 * HOUR
EXPIRY = 25 * HOUR


def series_keys(df: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    return list(keys) if keys is not None else [c for c in df.columns if c not in ("t", "value")]


def _w(keys):
    return Window.partitionBy(*keys).orderBy("t")


def _upto(keys):
    return _w(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def delta_to_cumulative(deltas: DataFrame, keys: Sequence[str] | None = None,
                        max_stale: int = MAX_STALE) -> DataFrame:
    """Running sum per stream of delta points (``t``, ``value``).

    A stream idle for more than ``max_stale`` seconds restarts from its next
    delta. No stream is refused, however many there are.

    Input deltas are compacted (A3: one row per stream and arrival batch),
    so a stream holds at most one row per batch however hot it is; the
    per-stream window is bounded by the time span, not by data volume. All
    three window expressions share one partitioning: one shuffle.
    """
    keys = series_keys(deltas, keys)
    df = deltas
    restart = F.coalesce((F.col("t") - F.lag("t").over(_w(keys))) > max_stale, F.lit(False))
    df = df.withColumn("_restart", restart) \
        .withColumn("_total", F.sum("value").over(_upto(keys)))
    base = F.last(F.when(F.col("_restart"), F.col("_total") - F.col("value")), ignorenulls=True) \
        .over(_upto(keys))
    return df.withColumn("value", (F.col("_total") - F.coalesce(base, F.lit(0))).cast("double")) \
        .drop("_restart", "_total")


def expire(samples: DataFrame, now: int, ttl: int = EXPIRY,
           keys: Sequence[str] | None = None) -> DataFrame:
    """The exported state at ``now``: last value per series, where a
    series without an update for ``ttl`` seconds has vanished."""
    keys = series_keys(samples, keys)
    last = samples.where(F.col("t") <= now).groupBy(*keys).agg(
        F.max("t").alias("t"), F.max_by("value", "t").alias("value"))
    return last.where(F.col("t") > now - ttl)


def counter_steps(samples: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """T4 helper: the growth credited at each sample from its predecessor;
    a drop is a reset (growth from 0); a series' first sample adds 0.
    Samples come one per scrape or arrival batch, so a series' window is
    bounded by the time span."""
    keys = series_keys(samples, keys)
    df = samples.withColumn("_prev", F.lag("value").over(_w(keys)))
    step = (F.when(F.col("_prev").isNull(), F.lit(0.0))
            .when(F.col("value") < F.col("_prev"), F.col("value"))
            .otherwise(F.col("value") - F.col("_prev")))
    return df.withColumn("step", step.cast("double")).drop("_prev")


def increase(samples: DataFrame, at: int, rng: int, keys: Sequence[str] | None = None) -> DataFrame:
    """T4 instant ``increase(x[rng])`` at ``at``: sum of steps with sample
    time in (at-rng, at]; a series with a sample in range yields a row."""
    keys = series_keys(samples, keys)
    steps = counter_steps(samples, keys)
    return (steps.where((F.col("t") > at - rng) & (F.col("t") <= at))
            .groupBy(*keys).agg(F.sum("step").alias("value")))


def _bucket_end(step: int) -> Column:
    return (F.ceil(F.col("t") / F.lit(step)) * F.lit(step)).cast("bigint")


def range_eval(samples: DataFrame, step: int, rng: int, fn: str = "increase",
               keys: Sequence[str] | None = None, start: int | None = None,
               end: int | None = None) -> DataFrame:
    """Evaluate ``fn(x[rng])`` at every multiple of ``step``.

    Samples are first reduced to one row per (series, bucket end) where the
    bucket is (e-step, e]; a range of m steps covers the m buckets ending at
    the evaluation time, which is exact for ranges that are multiples of the
    step. A sum gains a bucket's value at e and loses it at e + ``rng``: one
    running sum over these two rows per bucket, however long the range is;
    only the result has a row per step. ``fn`` is increase, min_over_time,
    max_over_time, count_over_time or rate_per_hour.
    """
    if fn in ("min_over_time", "max_over_time"):
        keys = series_keys(samples, keys)
        return _between(extremes_over_time(samples, step, rng, keys).select(
            *keys, "t", F.col(fn[:3] + "_value").alias("value")), start, end)
    if rng % step:
        raise ValueError("range must be a multiple of step")
    keys = series_keys(samples, keys)
    m = rng // step
    src = counter_steps(samples, keys) if fn in ("increase", "rate_per_hour") else samples
    agg = {"increase": F.sum("step"), "rate_per_hour": F.sum("step"),
           "count_over_time": F.count("value").cast("double")}[fn]
    out = src.groupBy(*keys, _bucket_end(step).alias("t")).agg(agg.alias("value"))
    if m > 1:
        moves = out.select(*keys, F.inline(F.array(
            F.struct(F.col("t"), F.col("value"), F.lit(1).alias("n")),
            F.struct((F.col("t") + rng).alias("t"), (-F.col("value")).alias("value"), F.lit(-1).alias("n")))))
        moves = moves.groupBy(*keys, "t").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        held = moves.select(*keys, "t", F.sum("value").over(_upto(keys)).alias("value"),
                            F.sum("n").over(_upto(keys)).alias("n"), F.lead("t").over(_w(keys)).alias("_next"))
        steps = F.explode(F.sequence("t", F.col("_next") - step, F.lit(step).cast("bigint")))
        out = held.where("n > 0").select(*keys, steps.alias("_t"), "value").withColumnRenamed("_t", "t")
    if fn == "rate_per_hour":
        out = out.withColumn("value", F.col("value") * F.lit(HOUR / rng))
    return _between(out, start, end)


def _between(out: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        out = out.where(F.col("t") >= start)
    if end is not None:
        out = out.where(F.col("t") <= end)
    return out


def extremes_over_time(samples: DataFrame, step: int, rng: int,
                       keys: Sequence[str] | None = None) -> DataFrame:
    """T6 at every multiple of ``step``: least and greatest sample of the
    trailing range (min_value, max_value) in one pass. The rows of the
    result are laid out first, each once; a sliding window fills them."""
    if rng % step:
        raise ValueError("range must be a multiple of step")
    keys = series_keys(samples, keys)
    buckets = samples.groupBy(*keys, _bucket_end(step).alias("t")).agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"))
    last = F.col("t") + (rng - step)
    until = F.least(F.coalesce(F.lead("t").over(_w(keys)) - step, last), last)
    rows = buckets.withColumn("_until", until).withColumn(
        "_t", F.explode(F.sequence("t", "_until", F.lit(step).cast("bigint"))))
    own = F.col("_t") == F.col("t")
    rows = rows.select(*keys, F.when(own, F.col("_min")).alias("_min"), F.when(own, F.col("_max")).alias("_max"),
                       F.col("_t").alias("t"))
    span = _w(keys).rangeBetween(step - rng, Window.currentRow)
    return rows.select(*keys, "t", F.min("_min").over(span).alias("min_value"), F.max("_max").over(span).alias("max_value"))


def rate_per_hour(samples: DataFrame, step: int, keys: Sequence[str] | None = None) -> DataFrame:
    """T5: trailing one-hour growth at every step, expressed per hour."""
    return range_eval(samples, step, HOUR, "rate_per_hour", keys)


def over_time(samples: DataFrame, fn: str, at: int, rng: int,
              keys: Sequence[str] | None = None) -> DataFrame:
    """T6 ``min_over_time`` / ``max_over_time`` at ``at``."""
    keys = series_keys(samples, keys)
    f = {"min": F.min, "max": F.max}[fn]
    return (samples.where((F.col("t") > at - rng) & (F.col("t") <= at))
            .groupBy(*keys).agg(f("value").alias("value")))


def instant(samples: DataFrame, at: int, lookback: int = 300,
            keys: Sequence[str] | None = None) -> DataFrame:
    """The last sample at or before ``at`` within the lookback."""
    keys = series_keys(samples, keys)
    return (samples.where((F.col("t") > at - lookback) & (F.col("t") <= at))
            .groupBy(*keys).agg(F.max_by("value", "t").alias("value")))


def instant_range(samples: DataFrame, step: int, ttl: int = EXPIRY,
                  keys: Sequence[str] | None = None, offset: int = 0) -> DataFrame:
    """T7/T8 at every multiple of ``step`` up to the last sample's, optionally
    shifted by ``offset`` (``x offset d`` is evaluated at t-d).

    Samples exist at change points only; the exporter shows a series at every
    scrape until it expires. A series' last value of each step is therefore
    carried on to the steps before its next change, for less than ``ttl``
    seconds after its sample (at most ``ttl / step`` steps per change)."""
    keys = series_keys(samples, keys)
    near = samples.groupBy(*keys, _bucket_end(step).alias("_e")).agg(
        F.max("t").alias("_t"), F.max_by("value", "t").alias("value"))
    w = Window.partitionBy(*keys).orderBy("_e")
    end = near.agg(F.max("_e")).scalar()
    near = near.withColumn("_next", F.lead("_e").over(w)).withColumn("_end", end)
    alive = (F.floor((F.col("_t") + ttl - 1) / step) * step).cast("bigint")
    until = F.least(F.coalesce(F.col("_next") - step, F.col("_end")), alive)
    steps = F.explode(F.sequence("_e", F.greatest(until, "_e"), F.lit(step).cast("bigint")))
    return near.select(*keys, steps.alias("_at"), "value").select(
        *keys, (F.col("_at") + F.lit(offset)).alias("t"), "value")


def offset(samples: DataFrame, at: int, d: int, lookback: int = 300,
           keys: Sequence[str] | None = None) -> DataFrame:
    """``x offset d`` evaluated at ``at``."""
    return instant(samples, at - d, lookback, keys)


def hourly_grid(hourly: DataFrame, end: int | None, fields: Sequence[str]) -> DataFrame:
    """Continuous hourly cumulative grid per model.

    ``hourly`` is (t, model, token_type, value). Each model gets every hour
    from its first active hour to ``end`` (exclusive); the global first hour
    bounds nothing else. Without ``end`` the grid ends with the last active
    hour of any model. The grid size is models x hours (bounded by the
    time span, not by data volume); idle hours carry the cumulative.
    Returns (t, model, token_type, value) for every ``fields`` type.
    """
    wide = hourly.groupBy("t", "model").pivot("token_type", list(fields)).agg(F.sum("value"))
    first = hourly.groupBy("model").agg(F.min("t").alias("_first"))
    last = hourly.agg(F.max("t")).scalar() if end is None else F.lit(end - HOUR)
    first = first.withColumn("_last", last.cast("bigint"))
    grid = first.select("model", F.explode(F.sequence("_first", "_last", F.lit(HOUR).cast("bigint"))).alias("t"))
    filled = grid.join(wide, ["t", "model"], "left").na.fill(0, subset=list(fields))
    # one row per model and hour: the window is bounded by the time span
    filled = filled.select("t", "model", *[F.sum(f).over(_upto(["model"])).alias(f) for f in fields])
    return filled.unpivot(["t", "model"], list(fields), "token_type", "value") \
        .withColumn("value", F.col("value").cast("bigint"))


def corpus_shrunk(snapshots: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per scan, 1 forever once any (model, token_type) total fell
    below the previous scan's (a vanished series counts as 0). ``scans``
    lists the scans, which need not be dense and may have found nothing."""
    scans = (scans if scans is not None else snapshots).select("scan").distinct()
    # one row per scan: short windows over scans, not over samples
    w = Window.orderBy("scan")
    order = scans.select("scan", F.lead("scan").over(w).alias("next"))
    prev = snapshots.join(order, "scan").where(F.col("next").isNotNull()).select(
        F.col("next").alias("scan"), "model", "token_type", F.col("value").alias("prev_value"))
    cmp = prev.join(snapshots, ["scan", "model", "token_type"], "left") \
        .withColumn("_drop", (F.coalesce("value", F.lit(0)) < F.col("prev_value")).cast("int"))
    flags = cmp.groupBy("scan").agg(F.max("_drop").alias("_drop"))
    per = scans.join(flags, "scan", "left").na.fill(0, ["_drop"])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("scan", F.max("_drop").over(upto).cast("int").alias("shrunk"))


def first_batch_growth(samples: DataFrame, step: int, rng: int, expiry: int = EXPIRY) -> DataFrame:
    """T12 at every step: growth summed over all series, where a newborn
    series (no sample within ``expiry`` before) counts from 0, so counters
    born non-zero are counted once; shown where some series has a sample in
    range, rounded."""
    keys = series_keys(samples)
    before_ = F.lag("t").over(_w(keys))
    born = before_.isNull() | (F.col("t") - before_ > expiry)
    steps = counter_steps(samples.withColumn("_born", born), keys)
    grown = steps.select(*keys, "t", F.when(F.col("_born"), F.col("value").cast("double")).otherwise(F.col("step")).alias("value"))
    ends = grown.groupBy(_bucket_end(step).alias("_e")).agg(F.sum("value").alias("value"))
    at = F.explode(F.sequence("_e", F.col("_e") + (rng - step), F.lit(step).cast("bigint")))
    return ends.select(at.alias("t"), "value").groupBy("t").agg(prom_round(F.sum("value")).alias("value"))
