"""Job references: repository and installation lookups, and where a job's credential comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions.text import is_present, parse_int, repo_owner, template, token_valid


def spread_nulls(key: Column, salt: Column) -> Column:
    """Join key for an outer join whose key is often null.

    Null keys all hash to one partition; a key no row can have, different per row, spreads them.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), salt.cast("string")))


def repo_with_installation(repos: DataFrame, installations: DataFrame) -> DataFrame:
    """Each repository with its installation, if it has one."""
    owner = installations.select(
        F.col("id").cast("string").alias("__key"),
        F.col("installation_id").alias("installation_ref"),
        "account_login",
    )
    keyed = repos.withColumn("__key", spread_nulls(F.col("installation_id"), F.col("id")))
    return keyed.join(owner, "__key", "left").drop("__key")


def job_includes(jobs: DataFrame, repos: DataFrame, installations: DataFrame) -> DataFrame:
    """Job, its repository, the repository's installation; both may be missing."""
    repo = repo_with_installation(repos, installations).select(
        F.col("id").cast("string").alias("__key"), F.col("name").alias("repo_name"), "installation_ref", "account_login"
    )
    keyed = jobs.withColumn("__key", spread_nulls(F.col("repo_id"), F.col("scan_id")))
    return keyed.join(repo, "__key", "left").drop("__key")


def installation_lookup(refs: DataFrame, installations: DataFrame, ref: str, salt: str) -> DataFrame:
    """Installation by its external id (unique); all of ``refs`` is kept."""
    found = installations.select(
        F.col("installation_id").alias("__key"),
        F.col("id").alias("found_id"),
        F.col("access_token").alias("found_token"),
        F.col("token_expires_at").alias("found_expires_at"),
    )
    keyed = refs.withColumn("__key", spread_nulls(F.nullif(F.col(ref), F.lit("")), F.col(salt)))
    return keyed.join(found, "__key", "left").drop("__key")


def unmatched_references(jobs: DataFrame, installations: DataFrame) -> DataFrame:
    """Jobs that name an installation nobody knows."""
    named = jobs.filter(~is_present(F.col("token")) & is_present(F.col("installation_id")))
    return named.join(installations.select("installation_id"), "installation_id", "left_anti")


def resolve(jobs: DataFrame, repos: DataFrame, installations: DataFrame, now: Column) -> DataFrame:
    """Credential source and state of each job, and the error that stops it, if any.

    Order: the job's token, the job's installation, the repository's installation, none. Empty
    strings count as missing.
    """
    with_repo = job_includes(jobs, repos, installations)
    source = (
        F.when(is_present(F.col("token")), "job_token")
        .when(is_present(F.col("installation_id")), "job_installation")
        .when(is_present(F.col("installation_ref")), "repo_installation")
        .otherwise("public")
    )
    ref = F.when(source == "job_installation", F.col("installation_id")).when(
        source == "repo_installation", F.col("installation_ref")
    )
    referred = with_repo.select(*jobs.columns, "repo_name", source.alias("auth_source"), ref.alias("auth_ref"))
    looked_up = installation_lookup(referred, installations, "auth_ref", "scan_id")
    state = (
        F.when(F.col("auth_source") == "job_token", "given")
        .when(F.col("auth_source") == "public", "none")
        .when(F.col("found_id").isNull(), "not_found")
        .when(token_valid(F.col("found_token"), F.col("found_expires_at"), now), "cached")
        .when(parse_int(F.col("auth_ref")).isNull(), "invalid_id")
        .otherwise("refresh")
    )
    error = (
        F.when(F.col("token_state") == "not_found", template(K.ERR_NO_INSTALLATION, F.col("auth_ref")))
        .when(F.col("token_state") == "invalid_id", template(K.ERR_BAD_INSTALLATION, F.col("auth_ref")))
        .when(~is_present(F.col("repo_url")), K.ERR_NO_URL)
        .when(repo_owner(F.col("repo_url")).isNull(), K.ERR_BAD_URL)
    )
    return looked_up.withColumn("token_state", state).withColumn("error", error)


def outcome(scan_id: Column, error: Column) -> Column:
    """Reply to a message: success with the scan id, or an error with a fallback text."""
    ok = F.to_json(F.struct(F.lit(True).alias("success"), scan_id.alias("scanId")))
    text = F.when(error != "", error).otherwise(K.ERR_FALLBACK)
    return F.when(error.isNull(), ok).otherwise(F.to_json(F.struct(text.alias("error"))))
