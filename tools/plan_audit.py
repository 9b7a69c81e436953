"""What each registered query does when it runs, from Spark's event log.

python tools/plan_audit.py [sf_dir [query...]]  ->  a Markdown table: jobs, stages that scan
Parquet, MB read and shuffled (all of them, eager jobs while the plan is built included),
and the costly operators of the plan that ran.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tablescope.plans.registry import queries  # noqa: E402

WATCHED = {
    "nested loop": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "expand": r"\bExpand \[",
    "row-wise Python": r"BatchEvalPython|ArrowEvalPython",
    "Arrow batches": r"MapInArrow|FlatMapGroupsInArrow",
    "unpartitioned window": r"Window \[[^\]]*windowspecdefinition\((?:specifiedwindowframe|[^,]*ASC|[^,]*DESC)",
}


def measured(log: str) -> dict[str, dict[str, float]]:
    """Sums by job group."""
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    group: dict[int, str] = {}
    for name in os.listdir(log):
        for line in open(os.path.join(log, name), errors="replace"):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                out[e["Properties"].get("spark.jobGroup.id", "")]["jobs"] += 1
            elif e["Event"] == "SparkListenerStageSubmitted":
                group[e["Stage Info"]["Stage ID"]] = e.get("Properties", {}).get("spark.jobGroup.id", "")
            elif e["Event"] == "SparkListenerStageCompleted":
                scopes = " ".join(json.loads(r["Scope"])["name"] for r in e["Stage Info"]["RDD Info"] if "Scope" in r)
                out[group[e["Stage Info"]["Stage ID"]]]["scans"] += "Scan parquet" in scopes
            elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                m, g = e["Task Metrics"], out[group.get(e["Stage ID"], "")]
                g["read"] += m["Input Metrics"]["Bytes Read"] / 1e6
                g["shuffled"] += m["Shuffle Write Metrics"]["Shuffle Bytes Written"] / 1e6
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    log = tempfile.mkdtemp(prefix="audit-")
    spark = (
        SparkSession.builder.master("local[4]").appName("plan-audit").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{log}")
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = {}
    for name, fn in sorted(queries().items()):
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        spark.sparkContext.setJobGroup(name, name)
        df = fn(spark, sf)
        df.collect()
        # collect() runs the frame's own plan: what is read here is the plan that ran
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    spark.stop()
    found = measured(log)
    print("| query | jobs | scan stages | MB read | MB shuffled | in the last plan |\n|---|---|---|---|---|---|")
    for name, plan in plans.items():
        m = found[name]
        ops = ", ".join(k for k, p in WATCHED.items() if re.search(p, plan))
        print(f"| {name} | {m['jobs']:.0f} | {m['scans']:.0f} | {m['read']:.2f} | {m['shuffled']:.2f} | {ops} |")


if __name__ == "__main__":
    main()
