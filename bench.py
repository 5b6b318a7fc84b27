"""Time the headline queries: one JSON line with the median seconds of each.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS the timed runs.
Every result is written to the no-op sink, so all columns of all rows are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from scanlake.plans.catalogue import QUERIES
from scanlake.session import build_session

HEADLINE = (
    # ingestion: report text to rows
    "severity_gate_from_reports", "findings_union", "read_sbom", "gosum_components", "read_junit", "read_cobertura",
    "read_lcov", "build_detail",
    # counting and gates
    "severity_totals_api", "totals_by_type", "totals_by_tool", "image_scan_summary", "gate_unified", "gate_policy",
    # lookups, summaries, ranking
    "scan_summary", "resolve_scan_dir", "resolve_build", "suppress_findings", "trace_findings", "top_findings", "top_issues",
    "phase_timeline", "phase_changes",
    # texts and inventory
    "apply_rules", "all_rule_sets", "credential_patterns", "detect_phase_documents", "detect_adapters", "test_dirs",
    # streams and sinks
    "stream_phase_changes", "windowed_findings", "stream_stale_agents", "write_finding_facts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "scanlake-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once(names[0])  # start the JVM's code caches before anything is timed
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
