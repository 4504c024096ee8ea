"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The value is the best of $BENCH_REPEATS runs after $BENCH_WARM_UPS; with repeats, p50, p95 and max
are given too (nearest rank).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ballast import catalog  # noqa: E402
from ballast.session import local_session  # noqa: E402

HEADLINES = [
    "Q1_workspace_report",
    "Q2_file_costs",
    "Q3_budget_gate",
    "Q4_manifest_guidance",
    "Q6_history_report",
    "Q7_store_maintenance",
    "Q8_incremental_worklist",
    "A1_report_rows",
    "A2_report_summary",
    "A3_duplicate_imports",
    "A4_shared_modules",
    "A5_treemap_shares",
    "A6_shared_bytes",
    "A9_file_cost",
    "A20_insights",
    "A21_latency_summary",
    "A22_artifact_sizes",
    "J1_resolve_installed",
    "J5_previous_measurement",
    "J6_changed_imports",
    "J7_stale_measurements",
    "J15_reachable_modules",
    "J18_changed_lines",
    "P4_apply_ignore_rules",
    "S3_extract_imports",
    "S4_manifest_dependencies",
    "T2_change_bursts",
    "W2_history_delta",
    "W5_retention_plan",
    "W6_registry_retention",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    warm_ups = int(os.environ.get("BENCH_WARM_UPS", "0"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    # one warm-up, so that the first query does not pay for class loading
    catalog.QUERIES["A2_report_summary"](spark, folder).collect()
    times: dict[str, float] = {}
    spread: dict[str, dict[str, float]] = {}
    for key in HEADLINES:
        runs = []
        for run in range(warm_ups + repeats):
            started = time.perf_counter()
            # the noop sink runs the whole plan without gathering rows on the driver
            catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            if run >= warm_ups:
                runs.append(time.perf_counter() - started)
        runs.sort()
        # nearest rank
        at = lambda share: round(runs[max(0, -(-len(runs) * share // 100) - 1)], 3)
        times[key] = round(runs[0], 3)
        spread[key] = {"p50": at(50), "p95": at(95), "max": round(runs[-1], 3)}
        print(f"{key} {times[key]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "spread": spread if repeats > 1 else {},
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
