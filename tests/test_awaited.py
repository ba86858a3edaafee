"""Reports that come early, in time, late and never, over batches and a restart."""

import datetime as dt

import pytest

from scanloom.plans import streams as streams_plan
from scanloom.session import fresh_path
from scanloom.streaming import jobs as js
from scanloom.streaming.awaited import awaited

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
JOBS = "scan_id string, tools array<string>, asked_at timestamp"
REPORTS = "scan_id string, tool string, arrived_at timestamp, stdout string"


def at(minutes):
    return None if minutes is None else ZERO + dt.timedelta(minutes=minutes)


@pytest.fixture
def streams(spark):
    """Two folders that fill up, and what has been settled so far."""
    paths = [fresh_path(spark, n) for n in ("asked", "came", "out", "checkpoint")]

    def run(jobs=(), reports=()):
        frames = [
            spark.createDataFrame([(s, t, at(m)) for s, t, m in jobs], JOBS),
            spark.createDataFrame([(s, t, at(m), x) for s, t, m, x in reports], REPORTS),
        ]
        for frame, path in zip(frames, paths):
            frame.coalesce(1).write.mode("append").parquet(path)
        asked, came = (spark.readStream.schema(f.schema).parquet(p) for f, p in zip(frames, paths))
        found = awaited(asked, came, lateness="5 minutes")
        query = found.writeStream.format("parquet").option("path", paths[2]).option("checkpointLocation", paths[3]).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
        rows = spark.read.schema(found.schema).parquet(paths[2]).collect()
        return sorted((r.scan_id or "", r.tool, r.status, r.reason, r.stdout) for r in rows), kept

    return run


def test_reports_are_awaited(streams):
    never, came = ("terminated", "time_limit", None), lambda x: ("arrived", None, x)
    # A report before its job; nothing else is settled yet.
    rows, _ = streams([("a", ["x", "y", "z"], 0), (None, ["x"], 0), ("n", None, 0), ("m", ["x"], None)], [("b", "x", 3, "b early"), ("a", "x", 4, "in time")])
    assert rows == [("a", "x", *came("in time"))]
    rows, _ = streams([("b", ["x", "y"], 3)], [("a", "y", 10, "at the limit"), ("b", "y", 2, "clock behind"), ("a", "q", 5, "not asked"), (None, "x", 1, "nameless"), ("c", "x", None, "no time")])
    assert rows == [("a", "x", *came("in time")), ("a", "y", *came("at the limit")), ("b", "x", *came("b early")), ("b", "y", *came("clock behind"))]
    # Too late for its job, then both streams move on.
    streams([("c", ["x"], 100)], [("a", "z", 11, "too late"), ("c", "x", 100, "c")])
    rows, kept = streams([("d", [], 300)], [("d", "x", 300, "d")])
    assert rows == [
        ("", "x", *never),
        ("a", "x", *came("in time")),
        ("a", "y", *came("at the limit")),
        ("a", "z", *never),
        ("b", "x", *came("b early")),
        ("b", "y", *came("clock behind")),
        ("c", "x", *came("c")),
    ]
    assert kept <= 2


def test_state_does_not_grow(streams):
    """A long run of jobs: what is kept follows the limit, not what has passed."""
    kept = []
    for step in range(4):
        span = range(step * 200, (step + 1) * 200)
        _, n = streams([(f"s{k}", ["x"], k) for k in span], [(f"s{k}", "x", k + 1, "r") for k in span if k % 2])
        kept.append(n)
    assert max(kept) <= 80
    rows, _ = streams([("end", [], 5000)], [("end", "x", 5000, "r")])
    assert len(rows) == 800 and sum(r[2] == "terminated" for r in rows) == 400


def test_messages_come_in_rounds(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(streams_plan, "fresh_path", lambda *a: folders.append(fresh_path(*a)) or folders[-1])
    jobs = spark.createDataFrame([(f"s{k}", ["x"], at(k * 60)) for k in range(9)] + [("n", ["x"], None)], JOBS)
    reports = spark.createDataFrame([(f"s{k}", "x", at(k * 60 + 1), "r") for k in range(9)], REPORTS)
    seen = []
    for _ in streams_plan._rounds(jobs, reports, most=4):
        inboxes = [spark.read.schema(df.schema).parquet(path) for df, path in zip((jobs, reports), folders[1::2])]
        seen.append([r.select(c).where(f"{c} < '2100-01-01'").toPandas()[c].max() for r, c in zip(inboxes, ("asked_at", "arrived_at"))])
    assert len(seen) == 3 and all(early[0] < late[0] and early[1] < late[1] for early, late in zip(seen, seen[1:]))
    # All messages, the job without a time and the closing ones.
    assert [r.count() for r in inboxes] == [11, 10]
