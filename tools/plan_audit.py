"""Audit the physical plan of every registered query: shuffles, broadcasts, joins, windows,
pushed-down filters and Python evaluation. Writes a markdown table (default PLANS.md).

Usage: python tools/plan_audit.py [sf_dir] [out.md]
The plan is the one Spark hands to AQE before execution (``isFinalPlan=false``); eager steps a
query takes while it is built (size probes, checkpoints, writes) are not part of it.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast joins": r"BroadcastHashJoin|BroadcastNestedLoopJoin",
    "windows": r"\bWindow \[",
    "partial top-k": r"WindowGroupLimit .*Partial",
    "python (Arrow batches)": r"MapInPandas|MapInArrow|PythonMapInArrow|ArrowEvalPython|FlatMapGroupsInPandas",
    "python (row UDF)": r"BatchEvalPython",
}


def audit(plan: str) -> dict[str, int]:
    reused = len(re.findall(r"Reused(Exchange|Subquery)", plan))
    # a reused exchange prints the original's description: count only the real ones
    plan = "\n".join(line for line in plan.splitlines() if "Reused" not in line)
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    out["reused"] = reused
    scans = re.findall(r"FileScan \w+ \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    out["scans"] = len(scans)
    out["scans with pushed filters"] = sum(1 for _, f in scans if f.strip())
    out["cross joins"] = len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_path = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")
    from worthrank.plans import REGISTRY
    from worthrank.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=16)
    cols = list(PATTERNS) + ["reused", "scans", "scans with pushed filters", "cross joins"]
    lines = [f"# Physical plan audit ({os.path.basename(sf_dir.rstrip('/'))}, Spark {spark.version})", "",
             "Counts per registered query, from the plan handed to AQE before execution. "
             "Generated by `tools/plan_audit.py`. A scalar subquery is printed at every reference "
             "in this plan text, so subquery-heavy rows over-count scans and single-partition "
             "exchanges; AQE executes an identical subquery once (e.g. `weighted_log_loss` runs "
             "4 jobs). Size probes, checkpoints and writes a query performs while it is built are "
             "not in these plans.", "",
             "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, q in REGISTRY.items():
        try:
            df = q.run(spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            a = audit(plan)
            lines.append(f"| {name} | " + " | ".join(str(a[c]) for c in cols) + " |")
        except Exception as e:  # noqa: BLE001
            lines.append(f"| {name} | error: {type(e).__name__} |" + " |" * (len(cols) - 1))
    with open(out_path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
