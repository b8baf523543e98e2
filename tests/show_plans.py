"""Print the key lines of the executed physical plans of headline queries
(scan pruning and pushed filters, exchanges, join strategies, partial
aggregates). Usage: python tests/show_plans.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterline.operators.dedup import dedup_replays  # noqa: E402
from meterline.plans import jobs  # noqa: E402
from meterline.plans.registry import queries  # noqa: E402
from meterline.session import build_session  # noqa: E402

HEADLINE = ["api_cost", "session_starts", "attribute_commits", "delta_to_cumulative"]
LANES = {
    "lane: ledger parse (S2 + S3)": lambda spark, sf: jobs.ledger_records(spark, sf),
    "lane: replay dedup (D1)": lambda spark, sf: dedup_replays(jobs.records_table(spark, sf)),
}
KEYS = ("Scan", "Exchange", "Join", "HashAggregate", "SortAggregate", "Window", "ArrowEval", "Subquery")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    q = queries()
    print("# Physical plans of headline queries\n")
    print(f"Generated by `tests/show_plans.py` at `{sf}` after execution (AQE final plans).\n")
    todo = [(n, q[n]) for n in HEADLINE] + list(LANES.items())
    for name, fn in todo:
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        for line in plan.split("\n"):
            if any(k in line for k in KEYS):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r"Location: [^,]*, ", "", line)
                width = 420 if "Scan" in line else 200
                print(line.rstrip()[:width])
        print("```\n")


if __name__ == "__main__":
    main()
