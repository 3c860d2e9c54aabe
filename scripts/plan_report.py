"""Plan shapes of every registered query as they would plan on a large
cluster: automatic broadcast off (only hinted, fixed-size tables are
broadcast), AQE off so the static physical plan is shown.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
For every query: shuffles (hash / range), broadcasts, single-partition
exchanges and what feeds each of those (a partial aggregate, a top-k, a
bounded sample, ...), joins by strategy, windows.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phaselens.plans import registry  # noqa: E402
from phaselens.session import get_session  # noqa: E402

BOUNDED_FEEDS = ("partial_", "TakeOrderedAndProject", "LocalLimit", "GlobalLimit")


def _single_partition_feeds(plan: str) -> list[str]:
    """Name of the operator right below each ``Exchange SinglePartition``."""
    lines = plan.splitlines()
    feeds = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and "ReusedExchange" not in line:
            nxt = lines[i + 1].strip().lstrip(":+- *()0123456789") if i + 1 < len(lines) else ""
            feeds.append(nxt.split("[")[0].split("(")[0].strip() + (" (partial)" if "partial_" in
                                                                    lines[i + 1] else ""))
    return feeds


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                                              "spark.sql.adaptive.enabled": "false"})
    print("| query | hash shuffles | range shuffles | broadcasts (hinted) | single-partition exchanges (fed by) "
          "| sort-merge / broadcast joins | windows |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in registry.queries().items():
        try:
            plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {str(e).splitlines()[0][:120]} | | | | | |")
            continue
        hashx = len(re.findall(r"Exchange hashpartitioning", plan))
        rangex = len(re.findall(r"Exchange rangepartitioning", plan))
        bcast = len(re.findall(r"BroadcastExchange", plan))
        feeds = _single_partition_feeds(plan)
        smj = len(re.findall(r"SortMergeJoin", plan))
        bhj = len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", plan))
        win = len(re.findall(r"\bWindow\b", plan))
        feed_txt = ", ".join(sorted(set(feeds))) if feeds else "-"
        print(f"| {name} | {hashx} | {rangex} | {bcast} | {len(feeds)} ({feed_txt}) | {smj} / {bhj} | {win} |")
    spark.stop()


if __name__ == "__main__":
    main()
