"""Hot keys against brute force, and plan shapes that must hold when nothing can be broadcast."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scanloom.operators import analytics, conform, credentials, detect, summary
from scanloom.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def hot(n, key="id"):
    """A third of the rows on key 7."""
    return F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("int")


def test_rolling_usage(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 7 if i % 3 == 0 else i % 50, i % 13, start + dt.timedelta(seconds=(i * 7919) % 40_000)) for i in range(3000)]
    usage = spark.createDataFrame(rows, "id INT, user_id INT, total_tokens INT, created_at TIMESTAMP_NTZ")
    got = {r["id"]: r["rolling_tokens"] for r in analytics.rolling_usage(usage, "user_id", 3600).collect()}
    per_user = defaultdict(list)
    for i, user, tokens, at in rows:
        per_user[user].append((at, tokens))
    want = {
        i: sum(t for a, t in per_user[user] if at - dt.timedelta(seconds=3600) <= a <= at) for i, user, _, at in rows
    }
    assert got == want


def test_chain_breaks(spark):
    start = dt.datetime(2024, 1, 1)
    words = ["clean", "dirty", None]
    rows = [
        (i, "hot" if i % 3 == 0 else f"f{i % 20}", words[i % 3], words[(i * 5 + 1) % 2], start + dt.timedelta(minutes=(i * 37) % 20_000))
        for i in range(2000)
    ]
    frame = spark.createDataFrame(
        rows, "id INT, fn STRING, previous_status STRING, new_status STRING, created_at TIMESTAMP_NTZ"
    )
    got = {r["fn"]: r["n_breaks"] for r in analytics.chain_breaks(frame, "fn").collect()}
    want = Counter()
    by_fn = defaultdict(list)
    for i, fn, previous, new, at in rows:
        by_fn[fn].append((at, i, previous, new))
    for fn, items in by_fn.items():
        items.sort(key=lambda x: x[:2])
        want[fn] = sum(1 for a, b in zip(items, items[1:]) if a[3] is not None and b[2] != a[3])
    assert got == dict(want)


def test_summary_and_numbering_of_a_hot_scan(spark):
    issues = spark.range(6000).select(
        F.concat(F.lit("s"), hot(50)).alias("scan_id"),
        (F.col("id") % 2).cast("int").alias("tool_rank"),
        F.lit("high").alias("severity"),
        F.col("id"),
    )
    # Positions as a report gives them: dense per scan and tool.
    seen, rows = Counter(), []
    for r in issues.orderBy("id").collect():
        key = (r["scan_id"], r["tool_rank"])
        rows.append((r["scan_id"], r["tool_rank"], seen[key], "high"))
        seen[key] += 1
    frame = spark.createDataFrame(rows, "scan_id STRING, tool_rank INT, pos INT, severity STRING")
    numbered = conform.number_issues(frame).collect()
    per_scan = defaultdict(list)
    for r in numbered:
        per_scan[r["scan_id"]].append((r["tool_rank"], r["pos"], r["ordinal"]))
    for items in per_scan.values():
        assert [o for _, _, o in sorted(items)] == list(range(1, len(items) + 1))
    scans = frame.select("scan_id").distinct().unionByName(spark.createDataFrame([("none",)], "scan_id STRING"))
    totals = {r["scan_id"]: r["total_issues"] for r in summary.scan_summary(scans, frame).collect()}
    assert totals == {**Counter(r[0] for r in rows), "none": 0}


def test_nullable_keys_keep_every_row(spark):
    repos = spark.range(3000).select(
        F.col("id").cast("int"), F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") % 3 == 0, 1).alias("installation_id")
    )
    inst = spark.createDataFrame([(1, "x", "acc")], "id INT, installation_id STRING, account_login STRING")
    rows = credentials.repo_with_installation(repos, inst)
    assert rows.count() == 3000 and rows.filter("installation_ref = 'x'").count() == 1000


def test_versions_compare_by_number(spark):
    packages = spark.createDataFrame([("1.9",), ("1.10",), ("1.10.1",), ("2.0",)], "version STRING").select(
        F.lit("s").alias("scan_id"), F.lit("/r").alias("scan_root"), F.lit("p").alias("path"), F.lit("lib").alias("name"), "version"
    )
    advisory = spark.createDataFrame([("lib", "A", "HIGH", "t", "1.10", "2.0")], "name STRING, id STRING, severity STRING, title STRING, introduced STRING, fixed STRING")
    found = detect.advisory_findings(packages, advisory).select("f.vuln.InstalledVersion").collect()
    assert sorted(r[0] for r in found) == ["1.10", "1.10.1"]


def test_secrets_anywhere_in_a_long_text(spark):
    filler = "x = 1\n" * 50_000
    text = filler + 'a token = "abcdefghijkl" b secret: "q"\n' + filler + 'password="last one"'
    files = spark.createDataFrame([("s", "/r", "/r/f", text), ("s", "/r", "/r/g", filler)], "scan_id STRING, scan_root STRING, path STRING, text STRING")
    rows = detect.as_issues(detect.secret_findings(files), "gitleaks").collect()
    assert sorted((r["file_path"], r["line_start"], r["code"]) for r in rows) == [
        ("f", 50_001, "***"), ("f", 50_001, "abcd***ijkl"), ("f", 100_002, "***"),
    ]


@pytest.fixture(scope="module")
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Streams and sinks have no single plan to look at.
PLANNED = sorted(n for n in QUERIES if not n.startswith(("t1", "t2", "t3", "t4", "k1")))


@pytest.mark.parametrize("name", PLANNED)
def test_plan_shape(spark, no_broadcast, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_plain_columns_reach_the_scan(spark, tmp_path):
    """A filter on top of a parse reaches the scan when it is on a column the scan has."""
    from scanloom.sources.jobs import parse_jobs

    spark.createDataFrame([(1, "{}", 5)], "message_id INT, body STRING, arrival INT").write.parquet(f"{tmp_path}/jobs")
    jobs = parse_jobs(spark.read.parquet(f"{tmp_path}/jobs")).filter("arrival > 3 and scan_id = 'a'")
    plan = jobs._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(arrival,3)" in plan and plan.count("from_json") == 1


def test_versions(spark):
    order = ["0.9", "1.0.0-rc1", "1.0", "v1.0.1", "1.2", "1.10", "2"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v STRING")
    assert [r["v"] for r in rows.orderBy(detect.version_key(F.col("v"))).collect()] == order
    same = spark.createDataFrame([("1.0", "1.0.0"), ("v1", "1.0"), ("1.0+b1", "1")], "a STRING, b STRING")
    assert same.filter(detect.version_key(F.col("a")) == detect.version_key(F.col("b"))).count() == 3
