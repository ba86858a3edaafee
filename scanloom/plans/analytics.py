"""Queries over declared tables without logic in the source system."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import analytics
from scanloom.plans.integrity import _ISSUES, _REVIEWS
from scanloom.plans.registry import query
from scanloom.sources import views


def _counted_scans(spark, d):
    """Stored scans with critical and high counters taken from the stored issues."""
    severe = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high")]
    counts = views.stored_issues(spark, d).groupBy("scan_id").agg(*severe)
    return views.stored_scans(spark, d).join(counts, "scan_id", "left").na.fill(0, ["critical_count", "high_count"])


_COMMENTS = """
, comment AS (SELECT conv_id % 20 AS repo_id, 'src/' || (conv_id % 40) || '.py' AS file_path, role = 'assistant' AS resolved,
  TIMESTAMP '2023-12-01' + to_hours((conv_id % 500)::BIGINT) AS created_at FROM conversations)
"""


@query(
    "d1_quality_gate",
    _REVIEWS + _COMMENTS + _ISSUES.replace("WITH issue", ", issue") + """
, counted AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM issue GROUP BY scan_id),
newest AS (SELECT o_custkey AS repo_id, arg_max(coalesce(c, 0), (o_orderdate, 'scan_' || o_orderkey)) AS c,
  arg_max(coalesce(h, 0), (o_orderdate, 'scan_' || o_orderkey)) AS h
  FROM orders LEFT JOIN counted ON scan_id = 'scan_' || o_orderkey GROUP BY o_custkey),
fn AS (SELECT repo_id, count(*) AS n, count(*) FILTER (status = 'clean') AS n_clean FROM review GROUP BY repo_id),
talk AS (SELECT repo_id, count(*) FILTER (NOT resolved) AS n_open FROM comment GROUP BY repo_id),
g AS (SELECT c_custkey::INT AS repo_id, c_mktsegment <> 'BUILDING' AS enabled,
  concat_ws(',', CASE WHEN c > c_custkey % 3 THEN 'critical' END, CASE WHEN h > 1 THEN 'high' END,
    CASE WHEN n_clean * 100 < 40 * n THEN 'clean' END, CASE WHEN c_custkey % 5 = 0 AND n_clean < n THEN 'all_clean' END,
    CASE WHEN c_custkey % 2 = 0 AND n_open > 0 THEN 'comments' END) AS reasons
  FROM customer LEFT JOIN newest ON newest.repo_id = c_custkey LEFT JOIN fn ON fn.repo_id = c_custkey
  LEFT JOIN talk ON talk.repo_id = c_custkey)
SELECT repo_id, CASE WHEN NOT enabled THEN 'off' WHEN reasons <> '' THEN 'failed' ELSE 'passed' END AS verdict,
  CASE WHEN enabled THEN reasons END AS reasons FROM g""",
)
def d1(spark, d):
    verdicts = analytics.gate_verdicts(
        views.quality_gates(spark, d), _counted_scans(spark, d), views.reviews(spark, d), views.comments(spark, d), views.now()
    )
    return verdicts.select("repo_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query(
    "d2_rolling_usage",
    """
SELECT event_id AS id, user_id::INT AS user_id, sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)::BIGINT AS rolling_tokens FROM events""",
)
def d2(spark, d):
    rolled = analytics.rolling_usage(views.usage_events(spark, d), "user_id", 86400)
    return rolled.select("id", "user_id", "rolling_tokens")


@query(
    "d2_period_usage",
    """
SELECT (user_id % 5)::INT AS team_id, strftime(ts, '%Y-%m-%d') AS period, sum(event_id % 97)::BIGINT AS tokens, count(*) AS n_events
FROM events GROUP BY 1, 2""",
)
def d2_period(spark, d):
    totals = analytics.period_usage(views.usage_events(spark, d), "team_id", "1 day")
    return totals.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "d3_scan_quota",
    """
WITH q AS (SELECT n_nationkey AS team_id, ['free', 'plus', 'pro'][n_nationkey % 3 + 1] AS tier, [10, 100, 1000][n_nationkey % 3 + 1] AS lim,
  TIMESTAMP '1998-01-01' + to_months(n_nationkey % 12) AS reset_date FROM nation),
u AS (SELECT team_id, count(*) FILTER (o_orderdate >= reset_date) AS used FROM orders JOIN q ON o_custkey % 4 <> 0 AND team_id = o_custkey % 7 GROUP BY team_id)
SELECT team_id, tier, coalesce(used, 0) AS used, lim AS scans_limit, greatest(lim - coalesce(used, 0), 0) AS remaining FROM q LEFT JOIN u USING (team_id)""",
)
def d3(spark, d):
    return analytics.quota_status(
        views.scan_quotas(spark, d), views.stored_scans(spark, d), {"free": 10, "plus": 100, "pro": 1000}
    )


@query(
    "d4_clean_percentage",
    _REVIEWS + """
SELECT repo_id, branch, count(*) AS n_functions, count(*) FILTER (status = 'clean') AS n_clean,
  floor(count(*) FILTER (status = 'clean') * 100 / count(*))::BIGINT AS clean_percentage FROM review GROUP BY repo_id, branch""",
)
def d4(spark, d):
    share = analytics.clean_percentage(views.reviews(spark, d), "repo_id", "branch")
    return share.withColumn("clean_percentage", F.floor("clean_percentage"))


_CHANGES = """
WITH ch AS (SELECT event_id AS id, (user_id % 20)::INT AS repo_id, 'fn' || user_id AS function_name,
  CASE WHEN event_type <> 'signup' THEN ['clean', 'dirty', 'unmarked'][event_id % 3 + 1] END AS previous_status,
  ['clean', 'dirty', 'unmarked'][(event_id + length(event_type)) % 3 + 1] AS new_status, ts FROM events)
"""


@query(
    "d5_latest_status",
    _CHANGES + """
SELECT repo_id, function_name, arg_max(new_status, (ts, id)) AS status, count(*) AS n_changes FROM ch GROUP BY repo_id, function_name""",
)
def d5(spark, d):
    return analytics.latest_status(views.status_changes(spark, d), "repo_id", "function_name")


@query("d5_transitions", _CHANGES + "SELECT previous_status, new_status, count(*) AS n FROM ch GROUP BY previous_status, new_status")
def d5_transitions(spark, d):
    return analytics.transitions(views.status_changes(spark, d))


@query(
    "d5_chain_breaks",
    _CHANGES + """
, seen AS (SELECT *, lag(new_status) OVER (PARTITION BY repo_id, function_name ORDER BY ts, id) AS before FROM ch)
SELECT repo_id, function_name, count(*) FILTER (before IS NOT NULL AND previous_status IS DISTINCT FROM before) AS n_breaks
FROM seen GROUP BY repo_id, function_name""",
)
def d5_breaks(spark, d):
    return analytics.chain_breaks(views.status_changes(spark, d), "repo_id", "function_name")


@query(
    "d6_open_comments",
    "WITH x AS (SELECT 1)" + _COMMENTS + """
SELECT repo_id::INT AS repo_id, file_path, count(*) FILTER (NOT resolved) AS n_open,
  date_sub('hour', min(created_at) FILTER (NOT resolved), TIMESTAMP '2024-01-01 00:10:00') AS oldest_hours FROM comment GROUP BY repo_id, file_path""",
)
def d6(spark, d):
    return analytics.open_comments(views.comments(spark, d), views.now(), "repo_id", "file_path")


@query(
    "d7_job_progress",
    """
SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, count(*) AS n_jobs,
  CASE WHEN o_orderstatus <> 'O' THEN floor(sum(o_orderkey % 50) * 100 / (50 * count(*)))::BIGINT END AS percent,
  CASE WHEN o_orderstatus <> 'O' THEN sum(o_orderkey % 600)::BIGINT END AS queued_seconds,
  CASE WHEN o_orderstatus = 'F' THEN sum(o_orderkey % 900)::BIGINT END AS run_seconds FROM orders GROUP BY o_orderstatus""",
)
def d7(spark, d):
    return analytics.job_progress(views.scan_jobs(spark, d))


@query(
    "d8_webhook_rates",
    """
SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(*) FILTER (event_id % 4 IN (0, 3)) AS n_success,
  floor(count(*) FILTER (event_id % 4 IN (0, 3)) * 100 / count(*))::BIGINT AS success_percent,
  max(CAST(json_extract(props, '$.k') AS INT)) AS max_k FROM events GROUP BY 1, 2""",
)
def d8(spark, d):
    return analytics.webhook_rates(views.webhook_events(spark, d), "k INT")


@query("d9_active_keys", "SELECT s_suppkey::INT AS id FROM supplier WHERE s_acctbal < 0 OR s_nationkey > 12")
def d9(spark, d):
    return analytics.active_keys(views.api_keys(spark, d), views.now()).select("id")


@query(
    "d10_triage",
    """
SELECT ['critical', 'high', 'medium', 'low', 'info', 'unknown'][l_quantity::INT % 6 + 1] AS severity,
  count(*) FILTER (l_returnflag = 'N') AS n_open, count(*) FILTER (l_returnflag = 'R') AS n_resolved,
  (sum(l_linenumber) FILTER (l_returnflag = 'R'))::BIGINT AS resolve_days FROM lineitem GROUP BY 1""",
)
def d10(spark, d):
    return analytics.triage(views.stored_issues(spark, d))
