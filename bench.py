"""Times the registered queries; prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_ALL=1 (every query, not only the headline ones).
The first query runs once untimed, so that the JVM is warm; every other time is of a single run.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "g1_scan_summary",
    "g2_tool_breakdown",
    "u1_union_all",
    "o1_issue_ordinal",
    "e2_poison_strict",
    "p1_semgrep_issue",
    "p5_trivy_issue",
    "k1_append_issues",
    "k2_complete_scan",
    "j1b_credential_source",
    "c3_orphan_counts",
    "c4_cascade",
    "j3a_team_members",
    "r1_secret_scan",
    "r2_pattern_scan",
    "r4_advisory_match",
    "t4_life_cycle",
    "d2_rolling_usage",
    "d10_triage",
]


def main() -> None:
    from scanloom.operators import conform, summary
    from scanloom.plans import QUERIES
    from scanloom.session import fresh_path, local_session
    from scanloom.sources import views
    from scanloom.sources.reports import store_reports, union_all
    from scanloom.sources.tables import table

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "scanloom-bench")
    QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    # The pipeline on its own: reports stored as a table beforehand, as a deployment has them.
    path = fresh_path(spark, "bench-reports")
    store_reports(union_all(list(views.reports(spark, folder).values())), path)
    stored = spark.read.parquet(path)
    reports = stored.count()
    start = time.perf_counter()
    counted = summary.scan_summary(views.scans(spark, folder), conform.all_issues(stored))
    counted.write.format("noop").mode("overwrite").save()
    seconds["stored_reports_to_summary"] = round(time.perf_counter() - start, 3)
    print(f"stored_reports_to_summary {seconds['stored_reports_to_summary']}", file=sys.stderr)
    result = {
        "metric": "scan findings, total of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "reports_per_second": round(reports / seconds["stored_reports_to_summary"]),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
