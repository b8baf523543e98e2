"""The price in effect at each step, or at one time for all."""

from __future__ import annotations

import datetime as dt

import pytest

from meterline.operators.vector import price_at

DAY = 86_400
KEYS = ["source", "model", "type"]
PRICES = [("codex", "m", "input", 1.0, None, dt.date(1970, 1, 10)), ("codex", "m", "input", 2.0, dt.date(1970, 1, 11), dt.date(1970, 1, 20)),
          ("codex", "m", "input", 3.0, dt.date(1970, 2, 1), None), ("codex", "n", "input", 5.0, None, None)]


def tables(spark, rows):
    usage = spark.createDataFrame(rows, "source string, model string, type string, t long, value double")
    prices = spark.createDataFrame(PRICES, "source string, model string, type string, usd_per_token double, effective_from date, effective_to date")
    return usage, prices


def brute(rows):
    out = []
    for *key, t, value in rows:
        day = dt.date(1970, 1, 1) + dt.timedelta(days=t // DAY)
        out += [(*key, t, value, p) for *k, p, a, b in PRICES if k == key and (a is None or a <= day) and (b is None or day <= b)]
    return sorted(out)


def test_step_mode_takes_the_price_of_each_time(spark):
    rows = [("codex", "m", "input", 3600 * i + d, float(i)) for i in range(24 * 45) for d in (0, 7)]  # a hot key
    rows += [("codex", "n", "input", 5, 1.0), ("codex", "m", "output", 5, 1.0), ("grok", "m", "input", 5, 1.0), ("codex", "m", "input", 5, 1.0)]
    usage, prices = tables(spark, rows)
    got = price_at(usage, prices)
    assert got.columns == [*usage.columns, "usd_per_token"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    at = {(r["t"], r["usd_per_token"]) for r in got.where("model = 'm'").collect()}
    assert (10 * DAY - 3600, 1.0) in at and (10 * DAY, 2.0) in at        # the 11th starts the second price
    assert max(t for t, p in at if p == 2.0) < 20 * DAY and min(t for t, p in at if p == 3.0) == 31 * DAY  # and a gap has none


def test_instant_mode_takes_one_price_for_all(spark):
    rows = [("codex", "m", "input", 5, 1.0), ("codex", "m", "input", 40 * DAY, 2.0), ("codex", "n", "input", 0, 4.0)]
    usage, prices = tables(spark, rows)
    price = lambda at: sorted((r["model"], r["t"], r["usd_per_token"]) for r in price_at(usage, prices, mode="instant", at=at).collect())
    assert price(10 * DAY) == [("m", 5, 2.0), ("m", 40 * DAY, 2.0), ("n", 0, 5.0)]
    assert price(25 * DAY) == [("n", 0, 5.0)]
    with pytest.raises(ValueError):
        price_at(usage, prices, mode="other")


def test_no_usage_and_no_prices(spark):
    usage, prices = tables(spark, [("codex", "m", "input", 5, 1.0)])
    assert price_at(usage.limit(0), prices).count() == 0 and price_at(usage, prices.limit(0)).count() == 0
