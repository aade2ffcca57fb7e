"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1). BENCH_CPUS: cores of the local session (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "severity_summary", "merge_findings", "overlapping_findings", "findings_in_chunks", "enclosing_symbol", "in_review_scope",
    "locate_evidence", "anchor_fingerprints", "score_risk", "apply_policy", "line_coverage", "fit_context", "history_items", "report_lines",
    "detect_language", "halve_chunks", "static_findings", "rename_consensus", "failure_streaks", "rate_limit", "concurrency",
    "sequence_events", "golden_metrics", "inference_stats", "windowed_rates", "review_state_machine",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from verdigris.plans.catalog import QUERIES
    from verdigris.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false",
        spark__verdigris__spread=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warms the session up, not counted
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
