"""Severity summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.constants import SEVERITIES

COUNTERS = [f"{s}_count" for s in SEVERITIES]


def counters():
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES]


def scan_summary(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """Five severity counters and a total per scan; scans without issues count zero.

    Counting is partial before the shuffle, so a scan with very many issues sends a handful of rows.
    """
    counts = issues.groupBy("scan_id").agg(*counters(), F.count("*").alias("total_issues"))
    return scans.select("scan_id").join(counts, "scan_id", "left").na.fill(0, [*COUNTERS, "total_issues"])


def tool_breakdown(requested: DataFrame, issues: DataFrame) -> DataFrame:
    """The same counters per (scan, requested tool), zeros for tools that found or returned nothing."""
    counts = issues.groupBy("scan_id", "tool").agg(*counters(), F.count("*").alias("total_issues"))
    runs = requested.select("scan_id", F.explode("tools").alias("tool"))
    return runs.join(counts, ["scan_id", "tool"], "left").na.fill(0, [*COUNTERS, "total_issues"])


def issue_count(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("n_issues"))


def tools_used(requested: DataFrame, issues: DataFrame) -> DataFrame:
    """Tools requested next to the tools that found something."""
    found = issues.groupBy("scan_id").agg(F.array_sort(F.collect_set("tool")).alias("found"))
    return requested.select("scan_id", "tools").join(found, "scan_id", "left").select(
        "scan_id",
        F.col("tools").alias("tools_used"),
        F.coalesce("found", F.array().cast("array<string>")).alias("tools_with_findings"),
    )
