"""Dense numbers of issues, and issues of failed scans."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scanloom.operators import conform, detect, ordinals, secrets, updates
from scanloom.sources import reports as src
from scanloom.sources import views

FOLDER = "/root/testdata/sf0.001"
FILE = "scan_id string, scan_root string, path string, text string"


def assert_dense(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.scan_id].append(r.ordinal)
    for numbers in by.values():
        assert sorted(numbers) == list(range(1, len(numbers) + 1))


@pytest.mark.parametrize("mode", ["strict", "quarantine"])
def test_reports_are_numbered_in_order(spark, mode):
    reports = views.reports(spark, FOLDER)
    rows = ordinals.numbered_issues(reports, mode).collect()
    plain = conform.all_issues(reports, mode)
    assert Counter((r.scan_id, r.tool, r.pos, r.title, r.code) for r in rows) == Counter(
        (r.scan_id, r.tool, r.pos, r.title, r.code) for r in plain.collect()
    )
    assert_dense(rows)
    for scan in {r.scan_id for r in rows}:
        places = sorted((r.tool_rank, r.pos, r.ordinal) for r in rows if r.scan_id == scan)
        assert [p[2] for p in places] == list(range(1, len(places) + 1))


def test_repeated_and_nameless_reports(spark):
    secret = '[{"Description":"d","StartLine":1,"EndLine":1,"File":"/r/f","Secret":"abc","RuleID":"x"},{"Description":"e","StartLine":2,"EndLine":2,"File":"/r/f","Secret":"abc","RuleID":"x"}]'
    rows = [("a", "gitleaks", secret), ("a", "gitleaks", secret), (None, "gitleaks", secret), (None, "gitleaks", secret), ("b", "gitleaks", "[]"), ("c", "gitleaks", None)]
    reports = spark.createDataFrame(rows, "scan_id string, tool string, stdout string").selectExpr(
        "scan_id", "tool", "'/r' as scan_root", "0 as exit_code", "cast(null as string) as signal", "stdout"
    )
    got = Counter((r.scan_id, r.ordinal) for r in ordinals.numbered_issues(reports, tools=["gitleaks"]).collect())
    assert got == Counter({**{("a", n): 1 for n in (1, 2, 3, 4)}, (None, 1): 2, (None, 2): 2})
    assert ordinals.numbered_issues(reports.where("false")).count() == 0


def test_reports_are_parsed_once(spark):
    """As many parses as for the issues alone, one exchange, and no issue is joined."""
    reports = views.reports(spark, FOLDER)
    explain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    reports = {name: frame for name, frame in reports.items() if name in ("gitleaks", "semgrep")}
    numbered, plain = ordinals.numbered_issues(reports, tools=list(reports)), conform.all_issues(reports, tools=list(reports))
    before = explain(plain)
    plan = explain(numbered)
    assert plan.count("from_json") == before.count("from_json")
    assert plan.count("Exchange hashpartitioning(scan_id") - before.count("Exchange hashpartitioning(scan_id") <= 1
    assert plan.count("Join") == before.count("Join")


def test_detected_issues(spark):
    """Several findings on a line and in several files, rows equal in all columns, one scan with most rows, in many tasks."""
    line = 'token="abcdefgh1" token="abcdefgh2" token="abcdefgh1"'
    files = [("hot", "/r", f"/r/{k % 50}", line) for k in range(300)] + [("b", "/r", "/r/x", f"{line}\n{line}"), (None, "/r", "/r/y", line)]
    frame = spark.createDataFrame(files, FILE).repartition(4)
    for found in (detect.secret_findings(frame), secrets.keyed_findings(frame)):
        rows = ordinals.dense_ordinals(detect.as_issues(found, "gitleaks")).collect()
        assert len(rows) == 3 * 303
        assert_dense(rows)
        hot = sorted((r for r in rows if r.scan_id == "hot"), key=lambda r: r.ordinal)
        assert [r.file_path for r in hot] == sorted(r.file_path for r in hot)
    assert ordinals.dense_ordinals(detect.as_issues(detect.secret_findings(frame.where("false")), "gitleaks")).count() == 0


def test_split_reports_without_their_bad_rows(spark):
    finding = '{"Description":"d","StartLine":%d,"EndLine":1,"File":"/r/f","Secret":%s,"RuleID":"x"}'
    rows = [("s", "gitleaks", "/r", k, finding % (k, "null" if k % 3 == 0 else '"abcdefghij"')) for k in range(60)]
    split = spark.createDataFrame(rows, "scan_id string, tool string, scan_root string, pos int, finding string").repartition(3)
    tool = conform.REGISTRY["gitleaks"]
    issues = conform.conform(src.read_split(split, tool.dialect, "quarantine"), tool)
    got = sorted((r.ordinal, r.pos) for r in ordinals.dense_ordinals(issues).collect())
    assert got == list(enumerate((k for k in range(60) if k % 3), 1))


def test_failed_scans_store_nothing(spark):
    columns = "scan_id string, tool string, severity string, title string, description string, file_path string, line_start int"
    whole = ("gitleaks", "high", "t", "d", "f", 1)
    rows = [("a", *whole), ("a", *whole), ("b", *whole), ("b", "gitleaks", "high", "t", "d", None, 1), ("c", *whole), ("c", "gitleaks", "high", None, "d", "f", 1), ("unknown", *whole), (None, *whole)]
    issues = spark.createDataFrame(rows, columns)
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scan_id string")
    kept = updates.staged_issues(issues, known)
    assert [r.scan_id for r in kept.collect()] == ["a", "a"] and kept.columns == issues.columns
    assert updates.staged_issues(issues.filter(F.lit(False)), known).count() == 0
