"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables, default sf0.1), BENCH_CPUS (local cores, default 8),
BENCH_RUNS (runs per query, best counts, default 2).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohort_engine.queries import QUERIES  # noqa: E402
from cohort_engine.session import build_session  # noqa: E402

HEADLINE = [
    "balanced_panel", "censored_panel", "service_counts", "referral_counts", "class_counts",
    "condition_profile", "enrolled_timeline", "roster_with_dates", "link_cascade", "linked_rosters",
    "built_sample", "coarsened_matching", "merged_with_status", "unambiguous_keys", "deduplicated",
    "sequence_in_group", "statistics_on_rows", "value_halves", "detailed_summary",
    "event_study", "event_study_by_group", "event_study_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rows_in_group"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline query time, sum of best runs", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
