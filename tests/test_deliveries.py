"""Deliveries counted in keyed state: rounds, restarts, closings, forgetting."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from scanloom.streaming import deliveries as dl
from scanloom.streaming import jobs as js
from tests.test_streaming import GOOD, NO_TITLE, Bench, deliver, message, report

MESSAGES = "job_key STRING, message_id BIGINT, arrival TIMESTAMP, body STRING"
CLOSINGS = "job_key STRING, status STRING"


class Rounds:
    """Each round is a new start of the stream from its checkpoint."""

    def __init__(self, spark, tmp, **options):
        self.spark, self.tmp, self.options = spark, tmp, options
        self.seen = 0

    def play(self, messages, closings=()):
        spark, tmp = self.spark, self.tmp
        rows = [(key, n, dt.datetime(2024, 1, day) if day else None, None) for key, n, day in messages]
        spark.createDataFrame(rows, MESSAGES).write.mode("append").json(f"{tmp}/messages")
        spark.createDataFrame(list(closings), CLOSINGS).write.mode("append").json(f"{tmp}/closings")
        counted = dl.counted(
            spark.readStream.schema(MESSAGES).json(f"{tmp}/messages"), spark.readStream.schema(CLOSINGS).json(f"{tmp}/closings"), **self.options
        )
        with dl.keyed_state(spark):
            js.append_available(counted, f"{tmp}/out", f"{tmp}/mark")
        out = spark.read.schema(dl.COUNTED).parquet(f"{tmp}/out")
        self.messages = sorted(r.message_id for r in out.where("kind = 'message'").collect())
        jobs = sorted((r.job_key, r.receives, r.received, r.verdict) for r in out.where("kind = 'job'").collect())
        fresh = [row for row in jobs if row not in getattr(self, "old", [])]
        self.old = jobs
        return fresh


def test_receives_are_counted_over_restarts(spark, tmp_path):
    r = Rounds(spark, tmp_path, max_receives=2)
    assert r.play([("a", 1, 1), ("a", 2, 1), ("b", 3, 1)]) == [("a", 2, 2, dl.RUN), ("b", 1, 1, dl.RUN)]
    assert r.play([("a", 1, 2), ("b", 3, 2)], [("b", "failed")]) == [("a", 3, 1, dl.DEAD), ("b", 2, 1, dl.RUN)]
    # A closing counts in the batch it comes with, whatever the order of rows, and for good.
    assert r.play([("a", 1, 2), ("b", 3, 2)], [("b", "completed"), ("a", None), ("nobody", "completed")]) == [
        ("a", 4, 1, dl.DEAD), ("b", 3, 1, dl.FINISHED)
    ]
    assert r.play([("b", 3, 2), ("nobody", 9, 2)]) == [("b", 4, 1, dl.FINISHED), ("nobody", 1, 1, dl.RUN)]
    assert r.messages == [1, 1, 1, 2, 3, 3, 3, 3, 9]


def test_jobs_are_forgotten(spark, tmp_path):
    r = Rounds(spark, tmp_path, retention="3 days")
    r.play([("a", 1, 1), ("b", 2, 1), ("b", 2, 4)], [("a", "completed")])
    r.play([("c", 3, 5)])
    r.play([("c", 3, 5)])
    # Four days after its last message, a starts anew; b was seen a day before. What is older than that is not read.
    assert r.play([("a", 1, 5), ("b", 2, 5), ("late", 8, 1)]) == [("a", 1, 1, dl.RUN), ("b", 3, 1, dl.RUN)]


def test_state_provider_is_put_back(spark):
    before = spark.conf.get(dl._PROVIDER)
    with dl.keyed_state(spark):
        assert spark.conf.get(dl._PROVIDER) == dl._ROCKSDB
    assert spark.conf.get(dl._PROVIDER) == before


class Counted(Bench):
    def run(self):
        plain = js.run_available
        js.run_available = lambda stream, run, mark: js.run_counted(stream, run, mark, max_receives=2)
        try:
            super().run()
        finally:
            js.run_available = plain


def test_jobs_run_by_count(spark, tmp_path, monkeypatch):
    b = Counted(spark, tmp_path, [report("a", GOOD), report("bad", NO_TITLE)])
    # Nothing that was written before may be read.
    monkeypatch.setattr(js.JobRun, "_read", lambda *_: 1 / 0)
    for minute in (0, 30, 45):
        deliver(spark, b.inbox, message(1, "a", minute), message(2, "bad", minute), message(3, None, minute, body="{"))
        b.run()
    assert b.rows(js.ISSUES, "scan_id", "title") == [("a", "Secret Detected: x")]
    # Batches without messages lie between, so rounds are not numbered one by one.
    assert b.rows(js.SCAN_UPDATES, "scan_id", "status", "failed_at") == [
        ("a", "completed", None), ("bad", "failed", "insert"), ("bad", "failed", "insert"), ("bad", "failed", "job"),
    ]
    assert b.rows(js.OUTCOMES, "message_id", "ok") == [(1, True)] * 3 + [(2, False)] * 3
    replies = js.read_output(spark, b.out, js.OUTCOMES).where("message_id = 2").orderBy("batch").collect()
    assert [js.GIVEN_UP in r.reply for r in replies] == [False, False, True]
    assert b.rows(js.DEAD_LETTERS, "message_id", "reason") == [(2, "receives")] + [(3, "bad_json")] * 3


def test_replayed_counted_batch_changes_nothing(spark, tmp_path):
    b = Counted(spark, tmp_path, [report("a", GOOD)])
    deliver(spark, b.inbox, message(1, "a"), message(2, "a", 1))
    b.run()
    names = {js.ISSUES: ["scan_id", "pos"], js.SCAN_UPDATES: ["scan_id", "status"], js.OUTCOMES: ["message_id", "ok"]}
    first = {n: b.rows(n, *c) for n, c in names.items()}
    kept = spark.read.parquet(f"{b.out}/{js.RECEIVED}/batch=000000000000").select([c.split()[0] for c in dl.COUNTED.split(", ")])
    again = spark.createDataFrame(kept.collect(), dl.COUNTED)
    b.job_run.process(again, 0)
    assert {n: b.rows(n, *c) for n, c in names.items()} == first


class _State:
    """As much of a group's state as ``_deliveries`` uses."""

    hasTimedOut, watermark, get, exists, timeout = False, 0, None, False, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_a_call_serves_a_bucket_of_jobs():
    of_bucket, state = dl._deliveries(2), _State()

    def play(*rows):
        frame = pd.DataFrame([(k, "1", None, "", closed, at) for k, closed, at in rows], columns=["job_key", *dl.UNCOUNTED, "closed", "millis"])
        out = pd.concat(of_bucket((0,), iter([frame]), state))
        return sorted(out[out["kind"] == dl.JOB][["job_key", "receives", "verdict"]].itertuples(index=False, name=None))

    assert play(("a", "", 5), ("b", "", 7), ("b", "", 6), ("c", "true", 0)) == [("a", "1", dl.RUN), ("b", "2", dl.RUN)]
    assert play(("b", "", 8), ("a", "true", 0), ("a", "", 5)) == [("a", "2", dl.FINISHED), ("b", "3", dl.DEAD)]
    assert state.timeout == 4
    state.watermark, state.hasTimedOut = 5, True
    assert list(of_bucket((0,), iter(()), state)) == [] and state.get[0] == ["b"] and state.timeout == 7
