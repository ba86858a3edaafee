"""Deliveries in several batches: copies, replays, failures, retries."""

import datetime as dt
import json

from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.operators import updates
from scanloom.streaming import jobs as js

GOOD = json.dumps([{"Description": "d", "StartLine": 1, "EndLine": 1, "File": "/r/f", "Secret": "abcdefghij", "RuleID": "x"}])
NO_TITLE = json.dumps([{"StartLine": 1, "EndLine": 1, "File": "/r/f", "Secret": "abcdefghij", "RuleID": "x"}])
NO_FILE = json.dumps([{"Description": "d", "StartLine": 1, "EndLine": 1, "Secret": "abcdefghij", "RuleID": "x"}])


def message(number, scan, minute=0, body=None, **job):
    job = {"scanId": scan, "repoId": 1, "repoUrl": "https://github.com/o/r", "branch": "main", "token": "t", **job}
    return (number, dt.datetime(2024, 1, 1, 0, minute), body if body is not None else json.dumps(job))


def deliver(spark, folder, *messages):
    spark.createDataFrame(list(messages), js.MESSAGE).coalesce(1).write.mode("append").json(folder)


class Bench:
    def __init__(self, spark, tmp, reports):
        self.spark, self.inbox, self.out, self.mark = spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/mark"
        self.reports = spark.createDataFrame(reports, schemas.REPORT)
        self.installations = [(7, "77")]

    def run(self):
        spark = self.spark
        repos = spark.createDataFrame([(1, "r", None)], "id INT, name STRING, installation_id INT")
        inst = spark.createDataFrame(
            [(i, ref, "acc", "tok", dt.datetime(2030, 1, 1)) for i, ref in self.installations],
            "id INT, installation_id STRING, account_login STRING, access_token STRING, token_expires_at TIMESTAMP_NTZ",
        )
        run = js.JobRun(
            self.out, repos, inst, F.to_timestamp_ntz(F.lit("2024-01-01")),
            lambda jobs: self.reports.join(jobs.select("scan_id"), "scan_id", "left_semi"),
        )
        self.job_run = run
        stream = spark.readStream.schema(js.MESSAGE).json(self.inbox)
        js.run_available(stream, run, self.mark)

    def rows(self, name, *columns):
        return sorted(map(tuple, js.read_output(self.spark, self.out, name).select(*columns).collect()))


def report(scan, stdout):
    return (scan, "gitleaks", "/r", 0, None, stdout)


def test_copies_and_redelivery(spark, tmp_path):
    b = Bench(spark, tmp_path, [report("a", GOOD), report("b", GOOD)])
    deliver(spark, b.inbox, message(1, "a"), message(2, "a", 1), message(3, "b"))
    b.run()
    assert b.rows(js.ISSUES, "scan_id", "title") == [("a", "Secret Detected: x"), ("b", "Secret Detected: x")]
    deliver(spark, b.inbox, message(1, "a", 30))
    b.run()
    took = b.rows(js.SCAN_UPDATES, "scan_duration")
    assert len(took) == 2 and all(0 < ms < 600_000 for (ms,) in took)  # in milliseconds, from the first report to the last finding
    # The finished scan is answered again but not scanned again.
    assert b.rows(js.ISSUES, "scan_id") == [("a",), ("b",)]
    assert b.rows(js.SCAN_UPDATES, "scan_id", "status", "total_issues") == [("a", "completed", 1), ("b", "completed", 1)]
    assert b.rows(js.OUTCOMES, "message_id", "ok") == [(1, True), (1, True), (2, True), (3, True)]


def test_failed_job_runs_when_redelivered(spark, tmp_path):
    b = Bench(spark, tmp_path, [report("a", GOOD)])
    deliver(spark, b.inbox, message(1, "a", token="", installationId="88"))
    b.run()
    assert b.rows(js.OUTCOMES, "ok", "reply") == [(False, '{"error":"Installation not found: 88"}')]
    outcomes = js.read_output(spark, b.out, js.OUTCOMES)
    assert [r["message_id"] for r in js.redrive(outcomes, 1).collect()] == [1] and js.redrive(outcomes, 2).isEmpty()
    b.installations.append((8, "88"))
    deliver(spark, b.inbox, message(1, "a", 5, token="", installationId="88"))
    b.run()
    assert b.rows(js.ISSUES, "scan_id") == [("a",)]
    assert b.rows(js.OUTCOMES, "ok") == [(False,), (True,)]
    assert js.redrive(js.read_output(spark, b.out, js.OUTCOMES), 1).isEmpty()
    assert b.rows(js.SCAN_UPDATES, "batch", "scan_id", "status") == [(0, "a", "failed"), (1, "a", "completed")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    b = Bench(spark, tmp_path, [report("a", GOOD), report("b", NO_TITLE), report("c", NO_FILE)])
    messages = [message(1, "a"), message(2, "b"), message(3, "c"), message(4, "d"), message(5, "e", repoUrl="")]
    deliver(spark, b.inbox, *messages)
    b.run()
    names = {
        js.ISSUES: ["scan_id", "pos"], js.SCAN_UPDATES: ["scan_id", "status", "failed_at"], js.OUTCOMES: ["message_id", "ok"],
        js.DEAD_LETTERS: ["message_id", "reason"],
    }
    first = {n: b.rows(n, *c) for n, c in names.items()}
    b.job_run.process(spark.createDataFrame(messages, js.MESSAGE), 0)
    assert {n: b.rows(n, *c) for n, c in names.items()} == first
    closed = js.read_output(spark, b.out, js.SCAN_UPDATES).select("scan_id", "status", "failed_at", "total_issues")
    assert sorted(map(tuple, closed.collect())) == [
        ("a", "completed", None, 1), ("b", "failed", "insert", 1), ("c", "failed", "path", 1), ("d", "completed", None, 0),
        ("e", "failed", "job", None),
    ]
    scans = spark.createDataFrame([(s, "running", 99) for s in "abcdez"], "scan_id STRING, status STRING, total_issues INT")
    after = updates.apply_log(scans, js.read_output(spark, b.out, js.SCAN_UPDATES), "batch")
    assert sorted(map(tuple, after.collect())) == [
        ("a", "completed", 1), ("b", "failed", 1), ("c", "failed", 99), ("d", "completed", 0), ("e", "failed", 99),
        ("z", "running", 99),
    ]
    assert first[js.DEAD_LETTERS] == [(5, "no_url")]
    assert first[js.ISSUES] == [("a", 0)]


def test_scan_stores_all_or_nothing(spark, tmp_path):
    both = json.dumps(json.loads(GOOD) + json.loads(NO_TITLE))
    b = Bench(spark, tmp_path, [report("a", both), report("b", GOOD)])
    for minute in (0, 30):
        deliver(spark, b.inbox, message(1, "a", minute), message(2, "b", minute))
        b.run()
    assert b.rows(js.ISSUES, "scan_id", "title") == [("b", "Secret Detected: x")]
    assert b.rows(js.SCAN_UPDATES, "batch", "scan_id", "failed_at") == sorted([(0, "a", "insert"), (0, "b", None), (1, "a", "insert")])


def test_jobs_without_a_scan_are_apart(spark, tmp_path):
    b = Bench(spark, tmp_path, [report("a", GOOD)])
    deliver(spark, b.inbox, message(1, None, body="{}"), message(2, None, repoUrl="https://example.com/x"), message(3, None), message(4, "a"))
    b.run()
    assert b.rows(js.OUTCOMES, "message_id", "ok") == [(1, False), (2, False), (3, True), (4, True)]
    assert b.rows(js.DEAD_LETTERS, "message_id", "reason") == [(1, "no_url")]
    assert b.rows(js.SCAN_UPDATES, "scan_id", "status") == [("a", "completed")]


def test_unreadable_messages_do_not_drop_each_other(spark, tmp_path):
    b = Bench(spark, tmp_path, [report("a", GOOD)])
    deliver(spark, b.inbox, message(1, "", body="nope"), message(2, "", body="{"), message(3, "a"))
    b.run()
    assert b.rows(js.DEAD_LETTERS, "message_id", "reason") == [(1, "bad_json"), (2, "bad_json")]
    assert b.rows(js.OUTCOMES, "message_id") == [(3,)]
