"""Job messages as a stream: at-least-once delivery with effects that happen once.

The stream's checkpoint remembers which messages are done. A micro-batch may be replayed after a
failure, so each of its outputs is a partition named after the batch id and a replay overwrites it.
Issues are written before the scan is closed; a reader that follows closed scans never sees half.
A scan stores all its issues or none: those of a scan that fails stay in the batch's findings.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scanloom.functions.text import epoch_micros
from scanloom.operators import conform, credentials, updates
from scanloom.sources import jobs as job_source
from scanloom.streaming import deliveries

MESSAGE = "message_id BIGINT, arrival TIMESTAMP, body STRING"

RECEIVED = "received"
OUTCOMES = "outcomes"
DEAD_LETTERS = "dead_letters"
FINDINGS = "findings"
ISSUES = "issues"
SCAN_UPDATES = "scan_updates"
RESOLVED = "resolved"
GIVEN_UP = "Job was received too often"
JOB_FIELDS = ("parse_error", "scan_id", "repo_id", "repo_url", "branch", "token", "installation_id")
RESOLVED_ROW = (
    "job_key STRING, scan_id STRING, repo_id INT, branch STRING, auth_source STRING, token_state STRING, error STRING,"
    " finished BOOLEAN"
)


def utc(ts: Column) -> Column:
    """Timestamp without zone, read as UTC whatever the session's zone is; watermarks need it."""
    return F.timestamp_micros(epoch_micros(ts))


def job_key() -> Column:
    """What tells jobs apart: the scan, or the message where it names none, or such jobs would be one."""
    return F.coalesce(F.col("scan_id"), F.concat(F.lit("message-"), F.col("message_id").cast("string")))


def deduplicate(jobs: DataFrame, within: str) -> DataFrame:
    """Drop redeliveries of a scan that arrive within the delay.

    Unreadable messages have no scan id and go by their message id, or they would drop each other.
    """
    keyed = jobs.withColumn("__key", job_key()).withWatermark("arrival", within)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


@dataclass
class JobRun:
    """One deployment of the job stream.

    ``reports_for`` gives the reports of a batch of runnable jobs (scan_id, …): the place where
    scanners are plugged in. ``None`` only answers the messages.
    """

    out: str
    repos: DataFrame
    installations: DataFrame
    now: Column
    reports_for: Callable[[DataFrame], conform.Reports] | None = None
    skip_tools: Column | None = None

    def process(self, messages: DataFrame, batch_id: int) -> None:
        """Parse, answer, scan and close one micro-batch."""
        spark = messages.sparkSession
        batch = f"{batch_id:012d}"
        # Written out once: the steps below start from this table, not from the message stream or its state.
        received = job_source.parse_jobs(messages)
        self._write(received, RECEIVED, batch)
        parsed = spark.read.schema(received.schema).parquet(f"{self.out}/{RECEIVED}/batch={batch}")
        verdicts = None
        if "kind" in parsed.columns:
            verdicts = parsed.filter(F.col("kind") == deliveries.JOB).select("job_key", "verdict")
            parsed = parsed.filter(F.col("kind") == deliveries.MESSAGE).select(*deliveries.UNCOUNTED, *JOB_FIELDS)
        parsed = parsed.withColumn("job_key", job_key())
        dead = None
        letters = parsed
        if verdicts is not None:
            letters = parsed.join(verdicts, "job_key", "left")
            dead = F.col("verdict") == deliveries.DEAD
        self._write(job_source.dead_letters(letters, dead).drop("verdict", "job_key"), DEAD_LETTERS, batch)

        # Copies of a job within the batch are one job; jobs finished earlier are not run again.
        jobs = job_source.readable(parsed)
        resolved = credentials.resolve(
            updates.newest(jobs, "job_key", "arrival"), self.repos, self.installations, self.now
        ).select("job_key", "scan_id", "repo_id", "branch", "auth_source", "token_state", "error")
        marked = self._mark_finished(spark, resolved, batch) if verdicts is None else self._mark_counted(resolved, verdicts)
        self._write(marked, RESOLVED, batch)
        todo = spark.read.schema(RESOLVED_ROW).parquet(f"{self.out}/{RESOLVED}/batch={batch}")

        stopped = todo.filter(F.col("error").isNotNull() & ~F.col("finished"))
        # A job that names no scan is answered, but has none to scan for or to close.
        closed = updates.job_failure(stopped.filter(F.col("scan_id").isNotNull()), self.now)
        stopped = stopped.select("job_key", "error")
        if self.reports_for is not None:
            runnable = todo.filter(F.col("error").isNull() & ~F.col("finished") & F.col("scan_id").isNotNull())
            closed = closed.unionByName(self._scan(spark, runnable, batch))
        self._write(closed, SCAN_UPDATES, batch)
        written = spark.read.schema("scan_id STRING, failed_at STRING").parquet(f"{self.out}/{SCAN_UPDATES}/batch={batch}")
        unusable = written.filter(F.col("failed_at").isin("path", "insert"))
        stopped = stopped.unionByName(
            unusable.select(F.col("scan_id").alias("job_key"), F.concat(F.lit("unusable issue: "), F.col("failed_at")).alias("error"))
        )
        # Every message is answered, copies included.
        replies = jobs.select("message_id", "scan_id", "job_key").join(stopped, "job_key", "left")
        self._write(
            replies.select(
                "message_id",
                "scan_id",
                F.col("error").isNull().alias("ok"),
                credentials.outcome(F.col("scan_id"), F.col("error")).alias("reply"),
            ),
            OUTCOMES,
            batch,
        )

    def _mark_finished(self, spark: SparkSession, jobs: DataFrame, batch: str) -> DataFrame:
        """Adds ``finished``: completed by an earlier batch (a replay does not see its own rows)."""
        closed = self._read(spark, SCAN_UPDATES)
        if closed is None:
            return jobs.withColumn("finished", F.lit(False))
        earlier = closed.filter((F.col("status") == "completed") & (F.col("batch").cast("bigint") < int(batch)))
        keys = earlier.select(F.col("scan_id").alias("job_key")).distinct().withColumn("finished", F.lit(True))
        return jobs.join(keys, "job_key", "left").na.fill(False, ["finished"])

    def _mark_counted(self, jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
        """The same from the keyed state; a job received too often stops with an error of its own."""
        dead = (F.col("verdict") == deliveries.DEAD) & F.col("error").isNull()
        rows = jobs.join(verdicts, "job_key", "left").withColumn("finished", F.coalesce(F.col("verdict") == deliveries.FINISHED, F.lit(False)))
        return rows.withColumn("error", F.when(dead, GIVEN_UP).otherwise(F.col("error"))).drop("verdict")

    def closings(self, spark: SparkSession) -> DataFrame:
        """The closed scans as a stream (job_key, status): each file is read once."""
        none = updates.job_failure(spark.createDataFrame([], "scan_id STRING"), self.now)
        none.write.mode("overwrite").parquet(f"{self.out}/{SCAN_UPDATES}/batch=-1")  # a folder to start from
        # A replay replaces the files of its batch; the new ones are read in their place.
        rows = spark.readStream.schema("scan_id STRING, status STRING, batch BIGINT").option("ignoreMissingFiles", True)
        return rows.parquet(f"{self.out}/{SCAN_UPDATES}").select(F.col("scan_id").alias("job_key"), "status")

    def _scan(self, spark: SparkSession, runnable: DataFrame, batch: str) -> DataFrame:
        """Store the issues of the batch's completed scans and return how its scans end."""
        start = time.monotonic()
        reports = self.reports_for(runnable)
        issues = conform.all_issues(reports, tools=list(reports) if isinstance(reports, dict) else None)
        rows = conform.sink_rows(issues, self.now)
        self._write(rows, FINDINGS, batch)
        # The scans of a batch run side by side: each took as long as all of them.
        took = F.lit(round((time.monotonic() - start) * 1000))
        # Judged and stored from what was written: the reports are not parsed again.
        found = spark.read.schema(rows.schema).parquet(f"{self.out}/{FINDINGS}/batch={batch}")
        skip = F.array().cast("array<string>") if self.skip_tools is None else self.skip_tools
        requested = runnable.select("scan_id", conform.tools_to_run(skip).alias("tools"))
        closed = updates.closing(runnable, found, requested, took, self.now)
        failed = closed.filter(F.col("failed_at").isNotNull()).select("scan_id")
        self._write(found.join(failed, "scan_id", "left_anti"), ISSUES, batch)
        return closed

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch}")

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.out}/{name}")
        except AnalysisException:  # nothing written yet
            return None


def redrive(outcomes: DataFrame, max_receives: int) -> DataFrame:
    """Messages that failed ``max_receives`` times or more and never succeeded: for the dead-letter queue."""
    tries = outcomes.groupBy("message_id").agg(
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.bool_or("ok").alias("succeeded"),
        F.max(F.struct("batch", "reply"))["reply"].alias("reply"),
    )
    return tries.filter(~F.col("succeeded") & (F.col("n_failed") >= max_receives)).drop("succeeded")


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def run_available(stream: DataFrame, run: JobRun, checkpoint: str) -> None:
    """Process everything that has arrived, then stop; call again for what arrives later."""
    query = (
        stream.writeStream.foreachBatch(run.process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_counted(
    stream: DataFrame, run: JobRun, checkpoint: str, max_receives: int = deliveries.MAX_RECEIVES, retention: str = deliveries.RETENTION
) -> None:
    """The same with deliveries counted in keyed state: what was written before is not read again.

    A job that was received more than ``max_receives`` times without being completed is not run any more; its messages go
    to the dead letters. Finished jobs are known as long as ``retention`` remembers them.
    """
    spark = stream.sparkSession
    keyed = job_source.parse_jobs(stream).withColumn("job_key", job_key())
    counted = deliveries.counted(keyed, run.closings(spark), max_receives, retention)
    with deliveries.keyed_state(spark):
        query = (
            counted.writeStream.foreachBatch(run.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def append_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """The same for a plain append of the stream's rows to a Parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
