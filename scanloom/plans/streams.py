"""Streaming queries: each drains a table's files as a stream and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.plans.jobs import job_sql
from scanloom.plans.registry import query
from scanloom.plans.report_sql import COUNTERS, report_sql
from scanloom.session import fresh_path
from scanloom.sources import views
from scanloom.sources.jobs import parse_jobs
from scanloom.sources.tables import table, table_stream
from scanloom.streaming import deliveries
from scanloom.streaming import jobs as js
from scanloom.streaming.awaited import awaited


def _messages(spark, d):
    rows = views.job_messages(table_stream(spark, d, "events"))
    return rows.select(F.col("event_id").alias("message_id"), js.utc(F.col("arrival")).alias("arrival"), "body")


def _run(spark, d, reports_for=None):
    out = fresh_path(spark, "jobs")
    run = js.JobRun(out, views.repos(spark, d), views.installations(spark, d), views.now(), reports_for)
    js.run_available(_messages(spark, d), run, fresh_path(spark, "jobs-checkpoint"))
    return out


@query(
    "t1_job_stream",
    job_sql("""
SELECT event_id AS message_id, scan_id, error IS NULL AS ok, CASE WHEN error IS NULL THEN '{"success":true,"scanId":"' || scan_id || '"}'
  ELSE '{"error":"' || error || '"}' END AS reply FROM err"""),
)
def t1(spark, d):
    return js.read_output(spark, _run(spark, d), js.OUTCOMES).drop("batch")


@query("t2_redelivery", job_sql("SELECT event_id AS message_id, scan_id, parse_error FROM (SELECT event_id, CASE WHEN parse_error IS NULL THEN scan_id END AS scan_id, parse_error FROM msg)"))
def t2(spark, d):
    """Every message is delivered twice, the second time ten minutes later."""
    again = F.explode(F.array(F.lit(0), F.lit(10)))
    twice = _messages(spark, d).select("message_id", "arrival", "body", again.alias("late"))
    late = F.col("arrival") + F.make_dt_interval(mins=F.col("late"))
    jobs = parse_jobs(twice.select("message_id", late.alias("arrival"), "body"))
    once = js.deduplicate(jobs, "1 hour").select("message_id", "scan_id", "parse_error")
    out = fresh_path(spark, "once")
    js.append_available(once, out, fresh_path(spark, "once-checkpoint"))
    return spark.read.schema(once.schema).parquet(out)


@query(
    "t3_dead_letter",
    job_sql("""
SELECT event_id AS message_id, CASE WHEN parse_error IS NULL THEN scan_id END AS scan_id,
  CASE WHEN parse_error IS NOT NULL THEN parse_error ELSE 'no_url' END AS reason
FROM msg WHERE parse_error IS NOT NULL OR event_id % 5 = 4"""),
)
def t3(spark, d):
    return js.read_output(spark, _run(spark, d), js.DEAD_LETTERS).select("message_id", "scan_id", "reason")


@query(
    "t3_redrive",
    job_sql("""
SELECT event_id AS message_id, 1::BIGINT AS n_failed, '{"error":"' || error || '"}' AS reply FROM err WHERE error IS NOT NULL"""),
)
def t3_redrive(spark, d):
    return js.redrive(js.read_output(spark, _run(spark, d), js.OUTCOMES), 1)


@query(
    "t4_life_cycle",
    report_sql(
        job_sql(f"""
, counted AS (SELECT r.scan_id, {COUNTERS} FROM (SELECT scan_id FROM err WHERE error IS NULL) r LEFT JOIN iss USING (scan_id) GROUP BY r.scan_id),
stop AS (SELECT scan_id, bool_or(file_path IS NULL) AS no_path,
  bool_or(file_path IS NULL OR title IS NULL OR description IS NULL) AS bad FROM iss GROUP BY scan_id)
SELECT scan_id, CASE WHEN coalesce(bad, false) THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN bad THEN CASE WHEN no_path THEN 'path' ELSE 'insert' END END AS failed_at, total_issues, high_count
FROM counted LEFT JOIN stop USING (scan_id)
UNION ALL SELECT scan_id, 'failed', 'job', NULL, NULL FROM err WHERE error IS NOT NULL""").replace("WITH msg", ", msg", 1)
    ),
)
def t4(spark, d):
    def reports_for(jobs):
        # Chosen before their texts are made, so that orders meet the batch's jobs and no text is shuffled.
        return views.reports(spark, d, wanted=jobs)

    closed = js.read_output(spark, _run(spark, d, reports_for), js.SCAN_UPDATES)
    return closed.select(
        "scan_id", "status", "failed_at", *[F.col(c).cast("bigint").alias(c) for c in ("total_issues", "high_count")]
    )


_ROUNDS = 3


@query(
    "t3_counted_receives",
    f"""
WITH delivery AS (SELECT 'scan_' || event_id AS job_key, event_id, r, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS copies
                  FROM events, unnest(range({_ROUNDS})) AS rounds(r) WHERE r <= event_id % 4)
SELECT job_key, copies::BIGINT AS received, (copies * (r + 1))::BIGINT AS receives,
  CASE WHEN event_id % 5 < r THEN 'finished' WHEN copies * (r + 1) > {deliveries.MAX_RECEIVES} THEN 'dead' ELSE 'run' END AS verdict FROM delivery""",
)
def t3_counted(spark, d):
    """Three rounds of deliveries, each read by a stream that starts again; a round brings closings of the one before."""
    events = table(spark, d, "events")
    key = F.concat(F.lit("scan_"), F.col("event_id").cast("string")).alias("job_key")
    copies = F.when(F.col("event_type") == "click", 2).otherwise(1)
    inbox, closed, out, mark = (fresh_path(spark, name) for name in ("deliveries", "closings", "counted", "counted-checkpoint"))
    for n in range(_ROUNDS):
        sent = events.where(F.col("event_id") % 4 >= n).select(
            key, F.col("event_id").alias("message_id"), js.utc(F.col("ts")).alias("arrival"), F.lit("").alias("body"), copies.alias("copies")
        )
        sent = sent.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
        sent.write.mode("append").parquet(inbox)
        done = events.where(F.col("event_id") % 5 == n - 1).select(key, F.lit("completed").alias("status"))
        done.write.mode("append").parquet(closed)
        stream = lambda path, like: spark.readStream.schema(like.schema).parquet(path)
        # Events come in no order of time: kept for as long as any of them may be late.
        counts = deliveries.counted(stream(inbox, sent), stream(closed, done), retention="36500 days")
        with deliveries.keyed_state(spark):
            js.append_available(counts, out, mark)
    rows = spark.read.schema(deliveries.COUNTED).parquet(out).where(F.col("kind") == deliveries.JOB)
    return rows.select("job_key", "received", "receives", "verdict")


_MINUTES = "(o_custkey * 3 + t * 5) % 30 - 3"
_ARRIVES = "(o_orderkey + t) % 7 <> 0"


#: How many jobs a round brings, about: what is kept follows this number, not that of all jobs.
_JOBS_A_ROUND = 1_000_000


def _rounds(asked, sent, at=("asked_at", "arrived_at"), most=_JOBS_A_ROUND):
    """Two folders that fill up in order of time, as queues do: after each round, both as streams.

    A message from long after closes them: what no later message settles stays open. Rounds are cut at times, the same
    for both; messages without a time come first. Each message is staged once by round, and a round reads only its own.
    """
    spark = asked.sparkSession
    n = -(-asked.count() // most) or 1
    cuts = asked.select(F.unix_micros(at[0]).alias("t")).approxQuantile("t", [k / n for k in range(1, n)], 0.01 / n) if n > 1 else []
    staged, inboxes = [], []
    for df, time in zip((asked, sent), at, strict=True):
        path = fresh_path(spark, "staged")
        # A sum of comparisons: how many cuts a time has passed.
        passed = F.aggregate(F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>"), F.lit(0), lambda s, c: s + F.when(F.unix_micros(time) >= c, 1).otherwise(0))
        df.withColumn("round", passed).write.partitionBy("round").parquet(path)
        staged.append(spark.read.schema(f"{', '.join(f'{c} {k}' for c, k in df.dtypes)}, round INT").parquet(path))
        inboxes.append(fresh_path(spark, "inbox"))
    end = spark.sql("SELECT TIMESTAMP '2100-01-01 00:00:00' AS at")
    other = {"timestamp": F.col("at"), "string": F.lit("")}
    for k in range(len(set(cuts)) + 1):
        for df, rows, inbox in zip((asked, sent), staged, inboxes, strict=True):
            rows.where(F.col("round") == k).select(*df.columns).write.mode("append").parquet(inbox)
            if k == len(set(cuts)):
                shape = [other.get(kind, F.lit(None).cast(kind)).alias(c) for c, kind in df.dtypes]
                end.select(*shape).write.mode("append").parquet(inbox)
        yield tuple(spark.readStream.schema(df.schema).parquet(inbox) for df, inbox in zip((asked, sent), inboxes, strict=True))


@query(
    "t4_awaited_reports",
    f"""
WITH asked AS (
  SELECT 'scan_' || o_orderkey AS scan_id, tool, {_ARRIVES} AS sent, {_MINUTES} AS late
  FROM orders, (VALUES (0, 'semgrep'), (1, 'opengrep'), (2, 'gitleaks'), (3, 'checkov'), (4, 'trivy')) AS tools(t, tool)
  WHERE NOT (o_orderpriority = '2-HIGH' AND tool IN ('checkov', 'semgrep')))
SELECT scan_id, tool, CASE WHEN sent AND late BETWEEN -1 AND 10 THEN 'arrived' ELSE 'terminated' END AS status,
  CASE WHEN sent AND late BETWEEN -1 AND 10 THEN late END::BIGINT AS minutes FROM asked""",
)
def t4_awaited(spark, d):
    """Reports come before their jobs, in time, too late, or never."""
    orders = table(spark, d, "orders").withColumn("asked_at", js.utc(F.col("o_orderdate")))
    jobs = orders.join(views.requested_tools(spark, d), F.concat(F.lit("scan_"), "o_orderkey") == F.col("scan_id"))
    tools = F.posexplode(F.array(*[F.lit(t) for t in K.TOOLS])).alias("t", "tool")
    sent = orders.select("*", tools).where(_ARRIVES).select(
        F.concat(F.lit("scan_"), "o_orderkey").alias("scan_id"),
        "tool",
        (F.col("asked_at") + F.make_dt_interval(mins=F.expr(_MINUTES).cast("int"))).alias("arrived_at"),
    )
    out, mark = fresh_path(spark, "awaited"), fresh_path(spark, "awaited-checkpoint")
    for streams in _rounds(jobs.select("scan_id", "tools", "asked_at"), sent):
        settled = awaited(*streams)
        js.append_available(settled, out, mark)
    rows = spark.read.schema(settled.schema).parquet(out)
    minutes = F.timestamp_diff("MINUTE", F.col("asked_at"), F.col("arrived_at"))
    return rows.select("scan_id", "tool", "status", minutes.alias("minutes"))
