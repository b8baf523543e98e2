"""Run every registered query against its DuckDB oracle (like the driver's
correctness gate). Usage: python tests/check_oracles.py [sf_dir] [names...]"""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from meterline.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]")
    con = duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if only and name not in only:
            continue
        t0 = time.time()
        if name not in o:
            n = fn(spark, sf).count()
            print(f"{name:24s} ROWS-ONLY {n} rows {time.time() - t0:5.1f}s", flush=True)
            continue
        try:
            ok, msg = compare(fn(spark, sf), con, o[name])
        except Exception as exc:  # report and continue
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{name:24s} {'OK ' if ok else 'BAD'} {msg} {time.time() - t0:5.1f}s", flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
