"""Job messages: JSON bodies to typed jobs, unreadable ones apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.schemas import JOB
from scanloom.sources.reports import parse_document, sealed


def parse_jobs(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds the job's fields and ``parse_error`` (null when the body is a job)."""
    others = [c for c in messages.columns if c != body]
    parsed = messages.select("*", parse_document(F.col(body), f"STRUCT<{JOB}>").alias("message"))
    job = F.col("message")["r"]
    bad = F.when(F.col("message")["_corrupt_record"].isNotNull() | F.col(body).isNull(), "bad_json").when(
        job.isNull(), "no_job"
    )
    return sealed(
        parsed.select(
            *others,
            body,
            bad.alias("parse_error"),
            F.when(bad.isNull(), job["scanId"]).alias("scan_id"),
            F.when(bad.isNull(), job["repoId"]).alias("repo_id"),
            F.when(bad.isNull(), job["repoUrl"]).alias("repo_url"),
            F.when(bad.isNull(), job["branch"]).alias("branch"),
            F.when(bad.isNull(), job["token"]).alias("token"),
            F.when(bad.isNull(), job["installationId"]).alias("installation_id"),
        ),
        *others,
        body,
    )


def readable(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("parse_error").isNull()).drop("parse_error", "body")


def dead_letters(jobs: DataFrame, given_up: Column | None = None) -> DataFrame:
    """Messages no retry can help, with the reason; ``given_up`` marks those that were received too often."""
    rest = [c for c in jobs.columns if c not in ("parse_error", "body")]
    reason = F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(
        F.coalesce(F.col("repo_url"), F.lit("")) == "", "no_url"
    )
    if given_up is not None:
        reason = reason.when(given_up, "receives")
    return jobs.select(*rest, "body", reason.alias("reason")).filter(F.col("reason").isNotNull())
