"""Reports over declared tables that carry no logic of their own in the source system.

The columns are given, their meaning here is ours: gates, usage, quotas, review state, job progress,
webhooks, keys and triage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.text import elapsed, epoch_micros


def clean_percentage(reviews: DataFrame, *by: str) -> DataFrame:
    """Share of functions marked clean, in percent."""
    return reviews.groupBy(*by).agg(
        F.count("*").alias("n_functions"),
        F.count_if(F.col("status") == "clean").alias("n_clean"),
        (F.count_if(F.col("status") == "clean") * 100 / F.count("*")).alias("clean_percentage"),
    )


def open_comments(comments: DataFrame, now: Column, *by: str) -> DataFrame:
    """Unresolved comments and the age in hours of the oldest."""
    oldest = F.min(F.when(~F.col("resolved"), F.col("created_at")))
    return comments.groupBy(*by).agg(
        F.count_if(~F.col("resolved")).alias("n_open"), elapsed("hour", oldest, now).alias("oldest_hours")
    )


def latest_scan(scans: DataFrame) -> DataFrame:
    """Each repository's newest scan: a maximum per repository, not a sort of its scans."""
    newest = F.max(F.struct("created_at", "scan_id", "critical_count", "high_count")).alias("scan")
    return scans.groupBy("repo_id").agg(newest).select("repo_id", "scan.*")


def gate_verdicts(gates: DataFrame, scans: DataFrame, reviews: DataFrame, comments: DataFrame, now: Column) -> DataFrame:
    """Quality gate per repository: passed, failed with reasons, or off."""
    counts = latest_scan(scans).select("repo_id", "critical_count", "high_count")
    clean = clean_percentage(reviews, "repo_id")
    talk = open_comments(comments, now, "repo_id").select("repo_id", "n_open")
    joined = gates.join(counts, "repo_id", "left").join(clean, "repo_id", "left").join(talk, "repo_id", "left")
    tests = {
        "critical": F.col("critical_count") > F.col("max_critical_issues"),
        "high": F.col("high_count") > F.col("max_high_issues"),
        "clean": F.col("clean_percentage") < F.col("min_clean_percentage"),
        "all_clean": F.col("require_all_clean") & (F.col("n_clean") < F.col("n_functions")),
        "comments": F.col("block_on_unresolved_comments") & (F.col("n_open") > 0),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    verdict = F.when(~F.col("enabled"), "off").when(F.size(reasons) > 0, "failed").otherwise("passed")
    return joined.select(
        "repo_id", verdict.alias("verdict"), F.when(F.col("enabled"), reasons).alias("reasons")
    )


def rolling_usage(usage: DataFrame, key: str, seconds: int) -> DataFrame:
    """Tokens of the same key in the ``seconds`` up to and including each event.

    The frame reaches back one window length, so time is cut into slices of that length and an event
    is also handed to the next slice as history. A slice, not a key, is then a task's unit of work,
    and a key with a third of all events is spread over time.
    """
    width = seconds * 1_000_000
    at = epoch_micros(F.col("created_at"))
    slot = F.floor(at / width)
    copies = usage.select(
        *usage.columns, at.alias("__at"), F.posexplode(F.array(slot, slot + 1)).alias("__history", "__slot")
    )
    frame = Window.partitionBy(key, "__slot").orderBy("__at").rangeBetween(-width, Window.currentRow)
    summed = copies.withColumn("rolling_tokens", F.sum("total_tokens").over(frame))
    return summed.filter(F.col("__history") == 0).select(*usage.columns, "rolling_tokens")


def period_usage(usage: DataFrame, key: str, period: str) -> DataFrame:
    """Tokens per key and period."""
    span = F.window("created_at", period)
    return usage.groupBy(key, span["start"].alias("period")).agg(
        F.sum("total_tokens").alias("tokens"), F.count("*").alias("n_events")
    )


def quota_status(quotas: DataFrame, scans: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Scans since the reset date against the tier's limit."""
    # Counted by time first: a team with very many scans meets its quota as counts.
    times = scans.filter(F.col("team_id").isNotNull()).groupBy("team_id", "created_at").agg(F.count("*").alias("n"))
    by_team = times.join(quotas.select("team_id", "reset_date"), "team_id")
    since = F.when(F.col("created_at") >= F.col("reset_date"), F.col("n")).otherwise(F.lit(0))
    used = by_team.groupBy("team_id").agg(F.sum(since).cast("bigint").alias("used"))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("tier")]
    joined = quotas.join(used, "team_id", "left").na.fill(0, ["used"])
    return joined.select(
        "team_id", "tier", "used", limit.alias("scans_limit"), F.greatest(limit - F.col("used"), F.lit(0)).alias("remaining")
    )


def latest_status(changes: DataFrame, *function: str) -> DataFrame:
    last = F.max(F.struct("created_at", "id", "new_status")).alias("last")
    return changes.groupBy(*function).agg(last, F.count("*").alias("n_changes")).select(
        *function, F.col("last.new_status").alias("status"), "n_changes"
    )


def transitions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("previous_status", "new_status").agg(F.count("*").alias("n"))


def chain_breaks(changes: DataFrame, *function: str) -> DataFrame:
    """Changes whose previous status is not what the change before them set, per function.

    Neighbours are compared within a day; across days only each day's first and last change are, so
    a function with very many changes is sorted in day-sized pieces.
    """
    day = F.to_date("created_at").alias("day")
    rows = changes.select(*function, "id", "created_at", "previous_status", "new_status", day)
    order = ["created_at", "id"]
    before = F.lag("new_status").over(Window.partitionBy(*function, "day").orderBy(*order))
    within = rows.withColumn("before", before)
    broken = F.col("before").isNotNull() & ~F.col("previous_status").eqNullSafe(F.col("before"))
    days = within.groupBy(*function, "day").agg(
        F.count_if(broken).alias("n_within"),
        F.min(F.struct(*order, "previous_status")).alias("first"),
        F.max(F.struct(*order, "new_status")).alias("last"),
    )
    carried = F.lag("last").over(Window.partitionBy(*function).orderBy("day"))["new_status"]
    joined = days.withColumn("carried", carried)
    across = F.col("carried").isNotNull() & ~F.col("first.previous_status").eqNullSafe(F.col("carried"))
    return joined.groupBy(*function).agg(
        (F.sum("n_within") + F.count_if(across)).alias("n_breaks")
    )


PROGRESS = "filesProcessed INT, totalFiles INT, functionsDetected INT, currentFile STRING"


def job_progress(jobs: DataFrame) -> DataFrame:
    """Jobs by state: how far they are, how long they queued and ran."""
    progress = F.from_json("progress", PROGRESS)
    known = jobs.select(
        "status",
        progress["filesProcessed"].alias("done"),
        progress["totalFiles"].alias("total"),
        elapsed("second", F.col("created_at"), F.col("started_at")).alias("queued"),
        elapsed("second", F.col("started_at"), F.col("completed_at")).alias("ran"),
    )
    return known.groupBy("status").agg(
        F.count("*").alias("n_jobs"),
        F.floor(F.sum("done") * 100 / F.sum("total")).alias("percent"),
        F.sum("queued").alias("queued_seconds"),
        F.sum("ran").alias("run_seconds"),
    )


def webhook_rates(events: DataFrame, payload: str) -> DataFrame:
    """Outcome of webhook deliveries per source and day."""
    body = F.from_json("payload", payload)
    day = F.date_format("created_at", "yyyy-MM-dd")
    return events.groupBy("source", day.alias("day")).agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.floor(F.count_if(F.col("status") == "success") * 100 / F.count("*")).alias("success_percent"),
        F.max(body["k"]).alias("max_k"),
    )


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def triage(issues: DataFrame) -> DataFrame:
    """Open and resolved issues per severity, and the total time to resolve."""
    return issues.groupBy("severity").agg(
        F.count_if(F.col("status") == "open").alias("n_open"),
        F.count("resolved_at").alias("n_resolved"),
        F.sum(elapsed("day", F.col("created_at"), F.col("resolved_at"))).alias("resolve_days"),
    )
