"""Reports that jobs wait for: those that come in time, and tools that are given up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long a scanner may take, how far a report's clock may run behind its job's, and how late messages may be delivered.
LIMIT, SKEW, LATENESS = "10 minutes", "1 minute", "1 hour"


def awaited(jobs: DataFrame, reports: DataFrame, limit: str = LIMIT, skew: str = SKEW, lateness: str = LATENESS) -> DataFrame:
    """A row for each tool a job asked for: with its report, or ``terminated`` once none came within the limit.

    ``jobs`` (scan_id, tools, asked_at) and ``reports`` (scan_id, tool, arrived_at, …) are streams, in any order of delivery
    up to ``lateness``: a report may be read before its job. A report counts from ``skew`` before to ``limit`` after the
    time its job was asked. What comes later, or for a tool nobody asked for, counts for nothing. A tool that reports
    twice in time has two rows.

    Both sides have watermarks and the join an interval in time, so a row is kept no longer than the
    limit and the lateness, and each tool is settled as soon as the time of both streams has passed it. Jobs
    and reports without a time cannot be awaited and are left out; a job without a scan id waits for nothing and ends as
    terminated. The columns of a report are null for terminated tools, ``reason`` is ``time_limit`` then.
    """
    asked = jobs.where(F.col("asked_at").isNotNull()).withWatermark("asked_at", lateness)
    # Outer, as the filter inferred for an inner explode would take jobs without tools away before they move the watermark.
    asked = asked.select("scan_id", "asked_at", F.explode_outer("tools").alias("tool")).where(F.col("tool").isNotNull())
    came = reports.where(F.col("arrived_at").isNotNull()).withWatermark("arrived_at", lateness)
    came = came.withColumnsRenamed({"scan_id": "__scan", "tool": "__tool"})
    in_time = (
        (F.col("scan_id") == F.col("__scan"))
        & (F.col("tool") == F.col("__tool"))
        & (F.col("arrived_at") >= F.col("asked_at") - F.expr(f"INTERVAL {skew}"))
        & (F.col("arrived_at") <= F.col("asked_at") + F.expr(f"INTERVAL {limit}"))
    )
    absent = F.col("arrived_at").isNull()
    rest = [c for c in reports.columns if c not in ("scan_id", "tool")]
    return asked.join(came, in_time, "left_outer").select(
        "scan_id",
        "tool",
        "asked_at",
        F.when(absent, "terminated").otherwise("arrived").alias("status"),
        F.when(absent, "time_limit").alias("reason"),
        *rest,
    )
