"""Property tests: T1 against a brute-force model of stale-restart
cumulation, and order independence of A3 compaction."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.operators import aggregate as A
from meterline.operators import series as T
from meterline.operators.labels import LABELS

STALE = 100

deltas_st = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 1000),
                               st.integers(1, 50)), min_size=1, max_size=40)


def brute_force(rows):
    """Per stream, in time order: a gap over STALE restarts the sum."""
    out = {}
    for k in sorted({r[0] for r in rows}):
        per_t = {}
        for kk, t, v in rows:
            if kk == k:
                per_t[t] = per_t.get(t, 0) + v
        total, last = 0, None
        for t in sorted(per_t):
            if last is not None and t - last > STALE:
                total = 0
            total += per_t[t]
            last = t
            out[(k, t)] = total
    return out


@settings(max_examples=12, deadline=None)
@given(deltas_st)
def test_delta_to_cumulative_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, t long, value long")
    compacted = df.groupBy("k", "t").sum("value").withColumnRenamed("sum(value)", "value")
    got = {(r["k"], r["t"]): r["value"] for r in
           T.delta_to_cumulative(compacted, keys=["k"], max_stale=STALE).collect()}
    assert got == brute_force(rows)


@settings(max_examples=8, deadline=None)
@given(deltas_st, st.randoms())
def test_compaction_is_order_independent(spark, rows, rnd: random.Random):
    def frame(rs):
        data = [("m", "sum", "e", *([k] + [""] * (len(LABELS) - 1)), t, float(v)) for k, t, v in rs]
        cols = "metric string, kind string, env string, " + \
            ", ".join(f"{c} string" for c in LABELS) + ", t long, value double"
        return spark.createDataFrame(data, cols)

    shuffled = list(rows)
    rnd.shuffle(shuffled)
    a = A.compact_deltas(frame(rows), batch=F.col("t"))
    b = A.compact_deltas(frame(shuffled).repartition(3), batch=F.col("t"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
