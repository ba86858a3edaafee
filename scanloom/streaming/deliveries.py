"""Deliveries of jobs counted in keyed state: which to run, which are done, which are given up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How often a job may be received before it is given up, and how long a job is remembered after its last message.
MAX_RECEIVES, RETENTION = 3, "4 days"

#: Jobs are kept in buckets by hash: Python is called once a bucket and batch, as a call costs some milliseconds.
BUCKETS = 2048
_STATE = "job_keys ARRAY<STRING>, receives ARRAY<BIGINT>, finished ARRAY<BOOLEAN>, last ARRAY<BIGINT>"

MESSAGE, JOB = "message", "job"
RUN, FINISHED, DEAD = "run", "finished", "dead"
COUNTED = (
    "kind STRING, job_key STRING, message_id BIGINT, arrival TIMESTAMP, body STRING, received BIGINT, receives BIGINT, verdict STRING"
)
#: What is left of a message's row without the counts.
UNCOUNTED = ("message_id", "arrival", "body")
_FIELDS = [field.split()[0] for field in COUNTED.split(", ")]
#: All columns travel as text, for Pandas would round large numbers beside nulls and shift times without a zone.
_AS_TEXT = ", ".join(f"{name} STRING" for name in _FIELDS)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, as large keyed state should; others are left alone."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _deliveries(max_receives: int):
    """What a batch makes of a bucket of jobs: messages received, whether a job has finished, and the time that forgets it."""

    def of_bucket(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {name: rest for name, *rest in zip(*state.get, strict=True)} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        closed, received, newest = set(), {}, {}
        # A timed out bucket has no frames. Messages pass frame by frame, so that a job may have any number of them.
        for frame in () if state.hasTimedOut else frames:
            closed.update(frame["job_key"][frame["closed"] == "true"])
            came = frame[frame["closed"] == ""]
            for name, millis in zip(came["job_key"], came["millis"].tolist(), strict=True):
                received[name] = received.get(name, 0) + 1
                newest[name] = max(millis, newest.get(name, millis))
            if len(came):
                yield came.assign(kind=MESSAGE, received=None, receives=None, verdict=None)[_FIELDS]
        jobs = []
        for name in closed.intersection(known):  # closings of jobs that are unknown or forgotten change nothing
            known[name][1] = True
        for name, n in received.items():
            before, finished, last = known.get(name, (0, False, newest[name]))
            finished, receives = finished or name in closed, before + n
            known[name] = [receives, finished, max(last, newest[name])]
            verdict = FINISHED if finished else DEAD if receives > max_receives else RUN
            jobs.append((JOB, name, None, None, None, str(n), str(receives), verdict))
        if jobs:
            yield pd.DataFrame(jobs, columns=_FIELDS)
        kept = [(name, *rest) for name, rest in known.items() if rest[2] > watermark]
        if not kept:
            state.remove()
            return
        state.update(tuple(list(column) for column in zip(*kept, strict=True)))
        # A time runs out below the watermark, a job at it.
        state.setTimeoutTimestamp(max(min(last for *_, last in kept) - 1, 1))

    return of_bucket


def counted(messages: DataFrame, closings: DataFrame, max_receives: int = MAX_RECEIVES, retention: str = RETENTION) -> DataFrame:
    """Each batch's messages as they came (kind ``message``) and one row for each job among them (kind ``job``).

    ``messages`` (job_key, message_id, arrival, body) and ``closings`` (job_key, status) are streams. A job's row tells how
    often it was ``received`` in this batch and how often in all (``receives``), and what is to be done: it has
    ``finished`` when a closing came as completed, in this batch or before; else it is ``dead`` when it
    was received more than ``max_receives`` times; else it is to ``run``. The order of rows in a batch does not matter.

    A job is forgotten when messages are read that arrived ``retention`` after its last one, and starts anew
    then; messages and jobs older than that count as expired and are not read. A message without a time counts as arriving
    now. Closings of unknown jobs and closings that are not ``completed`` change nothing. Repeated messages are counted
    each: a delivery is what counts. State is an entry a job, in buckets by hash; a batch reads the buckets its jobs are in, and
    nothing that was written earlier.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    at = F.coalesce("arrival", F.current_timestamp()).alias("at")
    micros = F.unix_micros("arrival").cast("string").alias("arrival")
    came = messages.select("job_key", text("message_id"), micros, "body", at, F.lit("").alias("closed"))
    none = F.lit(None).cast("string")
    done = closings.select(
        "job_key",
        *[none.alias(c) for c in UNCOUNTED],
        F.lit(None).cast("timestamp").alias("at"),  # no time: never late, and moves no watermark
        F.coalesce(F.col("status") == "completed", F.lit(False)).cast("string").alias("closed"),
    )
    # One watermark for both, or a stream without closings would hold it back.
    millis = F.coalesce(F.unix_millis("at"), F.lit(0)).alias("millis")
    bucket = F.pmod(F.xxhash64("job_key"), F.lit(BUCKETS)).alias("bucket")
    both = came.unionByName(done).select("*", millis, bucket).withWatermark("at", retention)
    grouped = both.groupBy("bucket").applyInPandasWithState(
        _deliveries(max_receives), _AS_TEXT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    kinds = dict(field.split() for field in COUNTED.split(", "))
    typed = {"arrival": F.timestamp_micros(F.col("arrival").cast("bigint"))}
    return grouped.select(*[typed.get(c, F.col(c).cast(kinds[c])).alias(c) for c in _FIELDS])
