"""Writes: keyed updates and re-runnable appends over plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.conform import failure_flags, scan_failures
from scanloom.operators.summary import COUNTERS, counters
from scanloom.session import fresh_path, settings


def newest(updates: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row per key, the latest; equal times fall back to the other values, so that it is always
    the same row. Partial aggregation keeps a hot key cheap."""
    rest = [c for c in updates.columns if c not in (key, order_by)]
    last = updates.groupBy(key).agg(F.max(F.struct(order_by, *rest)).alias("last"))
    return last.select(key, "last.*")


def keyed_update(
    target: DataFrame, updates: DataFrame, key: str, columns: list[str], order_by: str | None = None
) -> DataFrame:
    """Set ``columns`` of the target rows whose key has an update; nulls in an update are written too.

    Updates without a target row are ignored, as by an UPDATE statement. With ``order_by`` the newest
    of several updates of a key wins; without it ``updates`` must hold a key once.
    """
    once = newest(updates, key, order_by) if order_by else updates
    new = once.select(
        key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns]
    )
    joined = target.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


COMPLETED = ["status", "tools_used", "scan_duration", "total_issues", *COUNTERS, "completed_at"]
FAILED = ["status", "completed_at"]


def completion(summary: DataFrame, requested: DataFrame, duration: Column, at: Column) -> DataFrame:
    """Update rows of finished scans: status, tools, duration, six counters, time."""
    return summary.join(requested, "scan_id").select("scan_id", *_closing_columns("completed", duration, at))


def _closing_columns(status: Column | str, duration: Column, at: Column) -> list[Column]:
    return [
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools_used"),
        duration.cast("int").alias("scan_duration"),
        F.col("total_issues").cast("int").alias("total_issues"),
        *[F.col(c).cast("int").alias(c) for c in COUNTERS],
        at.alias("completed_at"),
    ]


def failure(scan_ids: DataFrame, at: Column) -> DataFrame:
    """Update rows of failed scans: status and time only, counters stay."""
    return scan_ids.select("scan_id", F.lit("failed").alias("status"), at.alias("completed_at"))


def closing(scans: DataFrame, issues: DataFrame, requested: DataFrame, duration: Column, at: Column) -> DataFrame:
    """How each scan ends, from one pass over its issues.

    ``failed_at`` is null for completed scans, ``path`` or ``insert`` for failed ones. A scan stopped
    by an issue without a path stores no counters; one stopped at the insert has stored them.
    """
    facts = issues.groupBy("scan_id").agg(*counters(), F.count("*").alias("total_issues"), *failure_flags())
    rows = scans.select("scan_id").join(requested.select("scan_id", "tools"), "scan_id").join(facts, "scan_id", "left")
    rows = rows.na.fill(0, [*COUNTERS, "total_issues"]).na.fill(False, ["no_path", "null_field"])
    failed_at = F.when(F.col("no_path"), "path").when(F.col("null_field"), "insert")
    status = F.when(failed_at.isNull(), "completed").otherwise("failed")
    return rows.select("scan_id", failed_at.alias("failed_at"), *_closing_columns(status, duration, at))


def job_failure(scan_ids: DataFrame, at: Column) -> DataFrame:
    """Closing rows of scans whose job stopped before any scanner ran."""
    kinds = {"tools_used": "array<string>", "completed_at": None}
    values = {
        "status": F.lit("failed"), "completed_at": at,
        **{c: F.lit(None).cast(kinds.get(c, "int")) for c in COMPLETED if c not in FAILED},
    }
    return scan_ids.select("scan_id", F.lit("job").alias("failed_at"), *[values[c].alias(c) for c in COMPLETED])


def apply_log(scans: DataFrame, log: DataFrame, order_by: str) -> DataFrame:
    """Scan rows after all closings of a log, as if each had been applied in order.

    Status and time come from a scan's last closing, counters from its last closing that stored
    them: a failure keeps the counters it finds. Aggregation and join share one partitioning.
    """
    counted = [c for c in COMPLETED if c not in FAILED]
    stores = F.col("failed_at").isNull() | (F.col("failed_at") == "insert")
    last = log.groupBy("scan_id").agg(
        F.max(F.struct(order_by, *FAILED)).alias("last"),
        F.max(F.when(stores, F.struct(order_by, *counted))).alias("stored"),
    )
    joined = scans.join(last, "scan_id", "left")
    new = {c: (F.col("last"), F.col("last")[c]) for c in FAILED}
    new.update({c: (F.col("stored"), F.col("stored")[c]) for c in counted})
    return joined.select(
        *[F.when(new[c][0].isNotNull(), new[c][1]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in scans.columns]
    )


def close_scans(scans: DataFrame, closed: DataFrame) -> DataFrame:
    """Scan rows after one run, ``closed`` as given by ``closing``."""
    return apply_log(scans, closed.withColumn("__run", F.lit(0)), "__run")


def replace_scans(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """Target rows of other scans plus the fresh rows: a re-run scan does not double its issues."""
    again = fresh.select("scan_id").distinct()
    return target.join(again, "scan_id", "left_anti").unionByName(fresh)


def write_batch(rows: DataFrame, path: str, batch: str, placed: bool = False) -> None:
    """Write a batch's rows as its own partition, replacing what an earlier try of it left.

    Only the batch's partition is rewritten, so the cost follows the batch and not the table.
    The rebalance lets adaptive execution split a scan that fills more than one file. Rows that are ``placed`` come from
    files in which that is done, as ``staged_issues`` leaves them: each goes to a task of its own, which keeps its order.
    """
    spark = rows.sparkSession
    if not placed:
        rows = rows.hint("rebalance", "scan_id").sortWithinPartitions("scan_id")
    alone = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")}
    with settings(spark, alone if placed else {}):
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


# So many issues, some 64 bytes each when shuffled, are sorted in a task's memory.
SORTED_ROWS = 500_000
# They are shuffled in rounds of so many, three at most, as each round reads them all: a round's shuffle goes before the next.
ROUND_ROWS, MOST_ROUNDS = 50_000_000, 3


def _sorted_in_memory(spark: SparkSession, rows: int) -> dict[str, str]:
    """Settings for a join of ``rows`` issues: partitions that are sorted without a spill, a hot scan split from twice
    their size on, and the shuffle's files dropped as soon as the result is written."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions")
    usual = max(int(spark.conf.get(name, None) or 1) for name in names)
    return {
        names[0]: str(max(usual, -(-rows // SORTED_ROWS))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * SORTED_ROWS),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * 64 * SORTED_ROWS),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }


def staged_issues(issues: DataFrame, scan_ids: DataFrame) -> DataFrame:
    """The issues of scans that end well: one issue that fails its scan keeps all of that scan's issues out.

    Issues are written to the shared folder first and judged from there, so that reports are parsed once. Issues without a
    scan belong to none that is known and stay out. What is kept is written as well, a scan's issues side by side and files
    sorted by scan: issues are shuffled once, by the join that judges them, however often they are delivered from there.
    """
    spark = issues.sparkSession
    path = fresh_path(spark, "staged")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    found = stored(issues, "found")
    rows = found.count()
    rounds = min(MOST_ROUNDS, max(1, -(-rows // ROUND_ROWS)))
    with settings(spark, _sorted_in_memory(spark, -(-rows // rounds))):
        # A table as well: adaptive execution splits a hot scan only where both sides of the join come straight from a shuffle.
        failed = stored(scan_failures(found, scan_ids).select("scan_id"), "failed")
        for i in range(rounds):
            mine = found.filter(F.col("scan_id").isNotNull() & (F.pmod(F.xxhash64("scan_id"), F.lit(rounds)) == i))
            # A merge join whatever the number of failed scans: its partitions and their order are those of the files.
            kept = mine.join(failed.hint("merge"), "scan_id", "left_anti").sortWithinPartitions("scan_id")
            kept.write.mode("append").parquet(f"{path}/kept")
    return spark.read.schema(kept.schema).parquet(f"{path}/kept")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refresh_credentials(installations: DataFrame, refreshed: DataFrame, at: Column) -> DataFrame:
    """Store newly issued tokens: token, expiry and time of the touched rows."""
    updates = refreshed.select("id", "access_token", "token_expires_at", at.alias("updated_at"))
    return keyed_update(
        installations, updates, "id", ["access_token", "token_expires_at", "updated_at"], "token_expires_at"
    )
