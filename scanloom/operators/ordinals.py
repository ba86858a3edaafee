"""Dense numbers of a scan's issues, from report sizes or from one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.text import strip_root
from scanloom.operators.conform import ISSUE_FIELDS, REGISTRY, Reports, Tool, reports_of
from scanloom.session import fresh_path
from scanloom.sources import reports as src

#: Order of a scan's detected issues: by tool, file, place in it and then by content.
DETECTED = ("tool_rank", "file_path", "pos", "line_start", "line_end", "title", "severity", "code", "description", "recommendation")


def _issues(findings: Column, scan_root: Column, tool: Tool, fields: Sequence[str]) -> Column:
    """An array of findings as an array of issues with the ``fields``."""

    def issue(finding: Column) -> Column:
        mapped = tool.normalise(finding)
        mapped["file_path"] = strip_root(mapped["file_path"], scan_root)
        mapped["tool"] = F.lit(tool.name)
        return F.struct(*[mapped.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ISSUE_FIELDS if name in fields])

    return F.transform(findings, issue)


def numbered_issues(
    reports: Reports,
    mode: str = "strict",
    tools: list[str] | None = None,
    registry: dict[str, Tool] = REGISTRY,
    fields: Sequence[str] = tuple(name for name, _ in ISSUE_FIELDS),
) -> DataFrame:
    """All issues with ``ordinal``: 1, 2, 3… in each scan, tools in fixed order, findings in report order.

    Reports are parsed once and stay a row each until they are numbered: a scan meets as its few reports, whose sizes are
    summed up before any is exploded, and no finding is looked at for it. Several reports of one tool follow
    each other in any order. Reports without a scan are numbered each by itself. Only ``fields`` of an issue are made and
    moved: the optimizer does not see into the arrays.
    """
    frames = []
    for name in tools or registry:
        tool = registry[name]
        read = src.read_reports(reports_of(reports, name), tool.dialect, mode)
        found = _issues(F.col("findings"), F.col("scan_root"), tool, fields)
        frames.append(read.select("scan_id", F.lit(tool.rank).alias("tool_rank"), found.alias("found")))
    alone = F.when(F.col("scan_id").isNull(), F.monotonically_increasing_id())
    every = src.union_all(frames).select("*", F.greatest(F.coalesce(F.size("found"), F.lit(0)), F.lit(0)).alias("n"), alone.alias("alone"))
    earlier = Window.partitionBy("scan_id", "alone").orderBy("tool_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.select("scan_id", "tool_rank", "found", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = placed.select("scan_id", "tool_rank", "before", F.posexplode_outer("found").alias("pos", "issue"))
    ordinal = (F.col("before") + F.col("pos") + 1).cast("int").alias("ordinal")
    return rows.filter(F.col("pos").isNotNull()).select("scan_id", "tool_rank", "pos", "issue.*", ordinal)


def dense_ordinals(issues: DataFrame, order: Sequence[str] = DETECTED) -> DataFrame:
    """``issues`` of any source with ``ordinal``: 1, 2, 3… in each scan by ``order``; issues equal in it go in any order.

    For findings that come one a row, detected or from split reports, where several may share a position. One range
    exchange by scan and order splits a scan however large; a row's place is its place in its task plus the rows of
    the tasks before, and a scan starts at its least place. The sorted rows are written to the shared folder and
    read again. Issues without a scan are numbered as one.
    """
    spark = issues.sparkSession
    tie = issues.withColumn("__tie", F.monotonically_increasing_id())
    path = fresh_path(spark, "ordinals")
    ordered = tie.orderBy("scan_id", *order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    kept = spark.read.schema(ordered.schema).parquet(path)
    task = F.shiftright("__at", 33)
    bases, base = [], 0
    for row in kept.groupBy(task.alias("task")).count().orderBy("task").collect():  # a number a task
        bases.append((row["task"], base))
        base += row["count"]
    by_task = spark.createDataFrame(bases, "__task long, __base long")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    places = kept.join(by_task, task == F.col("__task")).withColumn("__place", F.col("__base") + within)
    starts = places.groupBy(F.col("scan_id").alias("__scan")).agg(F.min("__place").alias("__start"))
    numbered = places.join(starts, F.col("scan_id").eqNullSafe(F.col("__scan")))
    return numbered.select(*issues.columns, (F.col("__place") - F.col("__start") + 1).alias("ordinal"))
