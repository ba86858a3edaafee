import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scanloom.operators import updates
from scanloom.session import settings


def scans(spark):
    return spark.createDataFrame([("a", "running", 1), ("b", "running", 2), ("c", "done", 3)], "scan_id STRING, status STRING, n INT")


def test_keyed_update(spark):
    new = spark.createDataFrame(
        [("a", "old", 9, 1), ("a", "new", None, 2), ("zz", "x", 1, 1)], "scan_id STRING, status STRING, n INT, at INT"
    )
    rows = updates.keyed_update(scans(spark), new, "scan_id", ["status", "n"], "at").orderBy("scan_id").collect()
    # The newest update wins and writes its null; unknown keys do nothing; others stay.
    assert [tuple(r) for r in rows] == [("a", "new", None), ("b", "running", 2), ("c", "done", 3)]


def test_equal_times_pick_one_row(spark):
    new = spark.createDataFrame([("a", "x", 1), ("a", "y", 1)], "scan_id STRING, status STRING, at INT")
    assert updates.newest(new, "scan_id", "at").collect()[0]["status"] == "y"


def test_hot_key(spark):
    """A third of all updates on one key still gives one row for it."""
    new = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("k"), "id")).alias("scan_id"),
        F.col("id").cast("string").alias("status"),
        F.col("id").alias("at"),
    )
    rows = updates.keyed_update(scans(spark), new, "scan_id", ["status"], "at").collect()
    assert {r["scan_id"]: r["status"] for r in rows} == {"a": "29997", "b": "running", "c": "done"}


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "issues")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scan_id STRING, pos INT")
    updates.write_batch(rows, path, "1")
    updates.write_batch(rows.filter("pos = 1"), path, "2")
    updates.write_batch(rows, path, "1")
    assert updates.read_batches(spark, path).groupBy("batch").count().orderBy("batch").collect() == [(1, 2), (2, 1)]


def test_replace_scans(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "scan_id STRING, pos INT")
    fresh = spark.createDataFrame([("a", 9)], "scan_id STRING, pos INT")
    assert sorted(map(tuple, updates.replace_scans(old, fresh).collect())) == [("a", 9), ("b", 3)]
    again = updates.replace_scans(updates.replace_scans(old, fresh), fresh)
    assert sorted(map(tuple, again.collect())) == [("a", 9), ("b", 3)]


def test_log_applies_in_order(spark):
    """A later failure keeps the counters an earlier closing stored."""
    counters = "total_issues critical_count high_count medium_count low_count info_count".split()
    scans = spark.createDataFrame([("a", "running", 0)], "scan_id STRING, status STRING, total_issues INT")
    stored = spark.createDataFrame(
        [("a", "insert", "failed", ["x"], 5, *[3] * 6, None, 1)],
        "scan_id STRING, failed_at STRING, status STRING, tools_used ARRAY<STRING>, scan_duration INT, "
        + ", ".join(f"{c} INT" for c in counters) + ", completed_at TIMESTAMP_NTZ, run INT",
    )
    at = F.to_timestamp_ntz(F.lit("2024-01-01"))
    later = updates.job_failure(spark.createDataFrame([("a",)], "scan_id STRING"), at).withColumn("run", F.lit(2))
    rows = updates.apply_log(scans, stored.unionByName(later), "run").collect()
    assert [tuple(r) for r in rows] == [("a", "failed", 3)]


def issues(spark, n):
    """Six of ten on one scan, the rest on 97 others, one of which has an issue without a path."""
    number = F.col("id") % 97
    scan = F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), number))
    rows = spark.range(0, n, 1, 8).select(
        scan.alias("scan_id"), F.lit("gitleaks").alias("tool"), F.lit("high").alias("severity"),
        F.md5(F.col("id").cast("string")).alias("title"), F.lit("d").alias("description"),
        F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.col("id").alias("pos"),
    )
    return rows.withColumn("file_path", F.when(F.col("scan_id") != "s7", F.col("file_path")))


def files_of(folder):
    """The scans of each file's rows, in their order."""
    return [pq.ParquetFile(f).read(["scan_id"])["scan_id"].to_pylist() for f in sorted(folder.glob("*.parquet"))]


def test_delivered_issues_are_shuffled_once(spark, tmp_path):
    """Staged issues are judged and placed: neither reading nor delivering them shuffles or sorts them again."""
    found = issues(spark, 20_000)
    names = ["spark.sql.files.openCostInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(name) for name in names]
    kept = updates.staged_issues(found, found.select("scan_id").distinct())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan
    sc = spark.sparkContext
    sc.setLocalProperty("spark.jobGroup.id", "deliveries")
    try:
        for _ in range(2):
            updates.write_batch(kept, str(tmp_path), "1", placed=True)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(job) for job in sc.statusTracker().getJobIdsForGroup("deliveries")]
    assert len(jobs) >= 2 and all(len(job.stageIds) == 1 for job in jobs)
    assert [spark.conf.get(name) for name in names] == before

    want = found.filter("scan_id <> 's7'")
    got = updates.read_batches(spark, str(tmp_path)).select(want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    files = files_of(tmp_path / "batch=1")
    assert all(scans == sorted(scans) for scans in files)
    # Every scan in one file.
    assert sum(len(set(scans)) for scans in files) == len({scan for scans in files for scan in scans}) == 97


def test_hot_scan_fills_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(updates, "SORTED_ROWS", 1000)
    found = issues(spark, 60_000)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        kept = updates.staged_issues(found, found.select("scan_id").distinct())
    updates.write_batch(kept, str(tmp_path), "1", placed=True)
    files = files_of(tmp_path / "batch=1")
    hot = [scans.count("hot") for scans in files if "hot" in scans]
    assert len(hot) > 1 and sum(hot) == 36_000 and max(hot) < 18_000
    assert all(scans == sorted(scans) for scans in files)
    assert sum(map(len, files)) == found.filter("scan_id <> 's7'").count()


def test_rounds_keep_every_issue(spark, tmp_path, monkeypatch):
    """Many issues are shuffled in rounds: each scan belongs to one of them."""
    monkeypatch.setattr(updates, "ROUND_ROWS", 3000)
    found = issues(spark, 8000)
    kept = updates.staged_issues(found, found.select("scan_id").distinct())
    updates.write_batch(kept, str(tmp_path), "1", placed=True)
    want = found.filter("scan_id <> 's7'")
    got = updates.read_batches(spark, str(tmp_path)).select(want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    files = files_of(tmp_path / "batch=1")
    assert len(files) >= 3 and all(scans == sorted(scans) for scans in files)
    assert sum(len(set(scans)) for scans in files) == 97


def test_settings_return(spark):
    unset = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with pytest.raises(ZeroDivisionError), settings(spark, {"spark.sql.shuffle.partitions": "3", unset: "5"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get(unset) == "5"
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8" and spark.conf.get(unset, None) is None
