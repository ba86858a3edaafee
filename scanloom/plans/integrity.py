"""Integrity and relation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.catalogue import TABLES, Ref
from scanloom.operators import integrity, relations
from scanloom.plans.registry import query
from scanloom.sources import views
from scanloom.sources.tables import table

_ISSUES = """
WITH issue AS (
  SELECT 'scan_' || l_orderkey AS scan_id, ['semgrep', 'opengrep', 'gitleaks', 'checkov', 'trivy', 'other'][l_linenumber % 6 + 1] AS tool,
    ['critical', 'high', 'medium', 'low', 'info', 'unknown'][l_quantity::INT % 6 + 1] AS severity,
    l_partkey % 97 = 0 AS no_title, l_partkey % 89 = 0 AS no_description,
    CASE WHEN l_returnflag = 'N' THEN 'open' WHEN l_returnflag = 'A' THEN 'acknowledged' WHEN l_linestatus = 'F' THEN 'fixed'
      ELSE 'wontfix' END AS status, CASE WHEN l_returnflag = 'R' THEN (l_suppkey + 5)::INT END AS resolved_by, l_orderkey
  FROM lineitem)
"""


@query(
    "c1_not_null",
    _ISSUES + """
SELECT c AS column, CASE c WHEN 'title' THEN t WHEN 'description' THEN d ELSE 0 END AS n_null
FROM (SELECT count(*) FILTER (no_title) AS t, count(*) FILTER (no_description) AS d FROM issue),
  (VALUES ('scan_id'), ('tool'), ('severity'), ('title'), ('description'), ('file_path'), ('line_start'), ('created_at')) v(c)""",
)
def c1(spark, d):
    return integrity.null_counts(views.stored_issues(spark, d), TABLES["security_issues"])


@query(
    "c1_null_rows",
    _ISSUES + "SELECT scan_id, tool, count(*) AS n FROM issue WHERE no_title OR no_description GROUP BY scan_id, tool",
)
def c1_rows(spark, d):
    bad = integrity.null_rows(views.stored_issues(spark, d), TABLES["security_issues"])
    return bad.groupBy("scan_id", "tool").agg(F.count("*").alias("n"))


_REVIEWS = """
WITH review AS (
  SELECT d.doc_id, CAST(substr(source, 4) AS INT) AS repo_id, 'src/' || lang || '/' || (d.doc_id % 40) || '.py' AS file_path,
    CASE WHEN lang <> 'de' THEN 'main' END AS branch, n_chars % 9 AS line_start, n_chars % 9 + 3 AS line_end, lang,
    CASE quality WHEN 1 THEN 'clean' WHEN 0 THEN 'dirty' ELSE 'unmarked' END AS status
  FROM documents d LEFT JOIN labels USING (doc_id))
"""


@query(
    "c2_unique_keys",
    _REVIEWS + """
SELECT 'repo_id,file_path,branch,line_start,line_end' AS rule,
  repo_id || ',' || file_path || ',' || branch || ',' || line_start || ',' || line_end AS key, count(*) AS n
FROM review WHERE branch IS NOT NULL GROUP BY repo_id, file_path, branch, line_start, line_end HAVING count(*) > 1""",
)
def c2(spark, d):
    return integrity.unique_violations(views.reviews(spark, d), TABLES["code_reviews"])


@query(
    "c2_duplicate_rows",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def c2_rows(spark, d):
    return integrity.duplicates(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


_RESOLVER = Ref("resolved_by", "users", on_delete="set null")


@query(
    "c3_orphans",
    _ISSUES + """
SELECT scan_id, resolved_by, count(*) AS n FROM issue WHERE resolved_by NOT IN (SELECT s_suppkey FROM supplier)
GROUP BY scan_id, resolved_by""",
)
def c3(spark, d):
    lost = integrity.orphans(views.stored_issues(spark, d), _RESOLVER, views.users(spark, d))
    return lost.groupBy("scan_id", "resolved_by").agg(F.count("*").alias("n"))


@query(
    "c3_orphan_counts",
    _ISSUES + """
SELECT resolved_by, count(*) AS n_rows FROM issue WHERE resolved_by NOT IN (SELECT s_suppkey FROM supplier) GROUP BY resolved_by""",
)
def c3_counts(spark, d):
    return integrity.orphan_counts(views.stored_issues(spark, d), _RESOLVER, views.users(spark, d))


@query(
    "c4_cascade",
    """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
s AS (SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM gone) AS dead FROM orders),
i AS (SELECT coalesce(s.dead, false) AS dead FROM lineitem LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT 'github_repos' AS name, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n_kept, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_deleted FROM customer
UNION ALL SELECT 'security_scans', count(*) FILTER (NOT dead), count(*) FILTER (dead) FROM s
UNION ALL SELECT 'security_issues', count(*) FILTER (NOT dead), count(*) FILTER (dead) FROM i""",
)
def c4(spark, d):
    building = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    tables = {
        "github_repos": views.repos(spark, d),
        "security_scans": views.stored_scans(spark, d),
        "security_issues": views.stored_issues(spark, d),
    }
    effect = integrity.delete(tables, "github_repos", building.select(F.col("c_custkey").cast("int").alias("id")))
    gone = F.col("fate") == integrity.DELETED
    return integrity.union_all(
        [
            rows.agg(F.count_if(~gone).alias("n_kept"), F.count_if(gone).alias("n_deleted")).select(F.lit(name).alias("name"), "n_kept", "n_deleted")
            for name, rows in effect.fates.items()
        ]
    )


def _tally(name, **frames):
    """One row: the name and the size of each frame."""
    marked = integrity.union_all([frame.select(F.lit(label).alias("label")) for label, frame in frames.items()])
    return marked.agg(*[F.count_if(F.col("label") == label).alias(label) for label in frames]).select(
        F.lit(name).alias("name"), *frames
    )


@query(
    "c5_set_null",
    _ISSUES + """
, gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
SELECT 'security_issues' AS name, count(resolved_by) FILTER (resolved_by NOT IN (FROM gone)) AS n_set, 0::BIGINT AS n_blocking FROM issue
UNION ALL SELECT 'github_repos', count(*), count(*) FILTER (c_custkey % 50 IN (FROM gone)) FROM customer
UNION ALL SELECT 'users', (SELECT count(*) FROM supplier WHERE s_nationkey >= 5), 0""",
)
def c5(spark, d):
    leaving = table(spark, d, "supplier").filter(F.col("s_nationkey") < 5)
    tables = {
        "users": views.users(spark, d),
        "github_repos": views.repos(spark, d),
        "security_issues": views.stored_issues(spark, d),
    }
    effect = integrity.delete(tables, "users", leaving.select(F.col("s_suppkey").cast("int").alias("id")))
    kept = effect.kept
    set_rows = kept["security_issues"].filter(F.col("resolved_by").isNotNull())
    none = kept["users"].filter(F.lit(False))
    return integrity.union_all(
        [
            _tally("security_issues", n_set=set_rows, n_blocking=none),
            _tally("github_repos", n_set=kept["github_repos"], n_blocking=effect.blocking["github_repos"]),
            _tally("users", n_set=kept["users"], n_blocking=none),
        ]
    )


@query(
    "c6_lengths",
    _REVIEWS + """
SELECT 'branch' AS column, 0::BIGINT AS n_too_long UNION ALL SELECT 'content_hash', 0
UNION ALL SELECT 'commit_sha', count(*) FILTER (lang = 'fr') FROM review""",
)
def c6(spark, d):
    return integrity.too_long(views.reviews(spark, d), TABLES["code_reviews"])


@query(
    "c7_closed_sets",
    _ISSUES + """
SELECT 'tool' AS column, tool AS value, count(*) AS n FROM issue WHERE tool = 'other' GROUP BY tool
UNION ALL SELECT 'severity', severity, count(*) FROM issue WHERE severity = 'unknown' GROUP BY severity
UNION ALL SELECT 'status', status, count(*) FROM issue WHERE status = 'wontfix' GROUP BY status""",
)
def c7(spark, d):
    return integrity.outside_sets(views.stored_issues(spark, d), TABLES["security_issues"])


@query(
    "c8_defaults",
    """
SELECT 'scan_' || o_orderkey AS scan_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  0 AS total_issues, 0 AS info_count, NULL::INT AS scan_duration, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 3 END AS high_count FROM orders""",
)
def c8(spark, d):
    written = views.scans(spark, d).withColumn("high_count", F.when(F.col("status") == "completed", 3))
    full = integrity.apply_defaults(written, TABLES["security_scans"], views.now())
    return full.select(
        "scan_id", "status", "total_issues", "info_count", "scan_duration",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), "high_count",
    )


# --- the whole catalogue ---------------------------------------------------------------------------


@query(
    "c1_all_tables",
    _ISSUES + """
, fact AS (
  SELECT 'github_app_installations' AS "table", 'updated_at' AS column, 'null' AS fact, count(*) AS n FROM nation
  UNION ALL SELECT 'code_reviews', 'commit_sha', 'too_long', count(*) FILTER (lang = 'fr') FROM documents
  UNION ALL SELECT 'security_issues', 'tool', 'outside', count(*) FILTER (tool = 'other') FROM issue
  UNION ALL SELECT 'security_issues', 'severity', 'outside', count(*) FILTER (severity = 'unknown') FROM issue
  UNION ALL SELECT 'security_issues', 'status', 'outside', count(*) FILTER (status = 'wontfix') FROM issue
  UNION ALL SELECT 'security_issues', 'title', 'null', count(*) FILTER (no_title) FROM issue
  UNION ALL SELECT 'security_issues', 'description', 'null', count(*) FILTER (no_description) FROM issue)
SELECT * FROM fact WHERE n > 0""",
)
def c1_all(spark, d):
    """Nulls, lengths and closed sets of every shaped table; a fact that is not listed holds everywhere."""
    return integrity.facts(views.catalogue(spark, d))


@query(
    "c2_all_keys",
    _REVIEWS + """
SELECT 'code_reviews' AS "table", 'repo_id,file_path,branch,line_start,line_end' AS rule,
  to_json([repo_id::VARCHAR, file_path, branch, line_start::VARCHAR, line_end::VARCHAR])::VARCHAR AS key, count(*) AS n
FROM review WHERE branch IS NOT NULL GROUP BY repo_id, file_path, branch, line_start, line_end HAVING count(*) > 1
UNION ALL SELECT 'code_review_comments', 'id', (conv_id * 100 + turn)::VARCHAR, count(*) FROM conversations GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'security_scans', 'id', o_orderkey::VARCHAR, count(*) FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'security_scans', 'scan_id', 'scan_' || o_orderkey, count(*) FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'quality_gates', 'repo_id', c_custkey::VARCHAR, count(*) FROM customer GROUP BY 3 HAVING count(*) > 1""",
)
def c2_all(spark, d):
    return integrity.colliding_keys(views.catalogue(spark, d))


_REFERENCES = [
    ("team_members", "user_id", "users", "s_suppkey", "supplier"),
    ("team_members", "team_id", "teams", "s_nationkey % 4", "supplier"),
    ("activity_logs", "team_id", "teams", "user_id % 5", "events"),
    ("activity_logs", "user_id", "users", "CASE WHEN event_type <> 'view' THEN user_id END", "events"),
    ("ai_usage_events", "user_id", "users", "user_id", "events"),
    ("ai_usage_events", "team_id", "teams", "user_id % 5", "events"),
    ("invitations", "team_id", "teams", "c_nationkey % 5", "customer"),
    ("invitations", "invited_by", "users", "c_custkey % 50", "customer"),
    ("github_app_installations", "user_id", "users", "n_nationkey % 50", "nation"),
    ("github_repos", "user_id", "users", "c_custkey % 50", "customer"),
    ("github_repos", "team_id", "teams", "CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey % 5 END", "customer"),
    ("github_repos", "installation_id", "github_app_installations", "CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END", "customer"),
    ("code_reviews", "repo_id", "github_repos", "TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT)", "documents"),
    ("code_review_comments", "repo_id", "github_repos", "conv_id % 20", "conversations"),
    ("code_review_comments", "user_id", "users", "conv_id % 50", "conversations"),
    ("code_review_status_events", "repo_id", "github_repos", "user_id % 20", "events"),
    ("security_scans", "repo_id", "github_repos", "o_custkey", "orders"),
    ("security_scans", "user_id", "users", "CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 150 END", "orders"),
    ("security_scans", "team_id", "teams", "CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 7 END", "orders"),
    ("security_issues", "scan_id", "security_scans", "'scan_' || l_orderkey", "lineitem"),
    ("security_issues", "resolved_by", "users", "CASE WHEN l_returnflag = 'R' THEN l_suppkey + 5 END", "lineitem"),
    ("scan_quotas", "team_id", "teams", "n_nationkey", "nation"),
    ("quality_gates", "repo_id", "github_repos", "c_custkey", "customer"),
]
_TARGETS = """
target AS (
  SELECT 'users' AS parent, s_suppkey::VARCHAR AS value FROM supplier UNION SELECT 'teams', r_regionkey::VARCHAR FROM region
  UNION SELECT 'github_repos', c_custkey::VARCHAR FROM customer UNION SELECT 'github_app_installations', n_nationkey::VARCHAR FROM nation
  UNION SELECT 'security_scans', 'scan_' || o_orderkey FROM orders)"""


def _references_sql() -> str:
    parts = [
        f"SELECT '{name}' AS \"table\", '{column}' AS column, '{parent}' AS parent, ({value})::VARCHAR AS value FROM {source}"
        for name, column, parent, value, source in _REFERENCES
    ]
    return f"""
WITH entry AS ({" UNION ALL ".join(parts)}), {_TARGETS.strip()}
SELECT "table", "column", e.parent, e.value, count(*) AS n FROM entry e LEFT JOIN target t ON e.parent = t.parent AND e.value = t.value
WHERE e.value IS NOT NULL AND t.value IS NULL GROUP BY ALL"""


@query("c3_all_references", _references_sql())
def c3_all(spark, d):
    return integrity.dangling(views.catalogue(spark, d))


@query(
    "c7_all_sets",
    _ISSUES + """
SELECT 'security_issues' AS "table", 'tool' AS column, tool AS value, count(*) AS n FROM issue
WHERE tool NOT IN ('semgrep', 'opengrep', 'gitleaks', 'checkov', 'trivy') GROUP BY tool
UNION ALL SELECT 'security_issues', 'severity', severity, count(*) FROM issue WHERE severity NOT IN ('critical', 'high', 'medium', 'low', 'info') GROUP BY severity
UNION ALL SELECT 'security_issues', 'status', status, count(*) FROM issue WHERE status = 'wontfix' GROUP BY status
UNION ALL SELECT 'webhook_events', 'status', s, count(*) FROM (SELECT ['success', 'failure', 'pending', 'success'][event_id % 4 + 1] AS s FROM events)
  WHERE s NOT IN ('success', 'failure', 'pending') GROUP BY s
UNION ALL SELECT 'scan_jobs', 'status', s, count(*) FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS s FROM orders)
  WHERE s NOT IN ('queued', 'running', 'completed', 'failed') GROUP BY s""",
)
def c7_all(spark, d):
    tables = views.catalogue(spark, d)
    judged = {name: rows for name, rows in tables.items() if any(c.values and c.name in rows.columns for c in TABLES[name].columns)}
    outside = [integrity.outside_sets(rows, TABLES[name]).withColumn("table", F.lit(name)) for name, rows in judged.items()]
    return integrity.union_all(outside)


@query(
    "c5_blocking_references",
    """
WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5),
lost AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 50 IN (FROM gone))
SELECT 'github_repos' AS name, "column", count(*) AS n FROM (
  SELECT unnest([CASE WHEN c_custkey % 50 IN (FROM gone) THEN 'user_id' END,
                 CASE WHEN c_nationkey % 5 <> 0 AND c_nationkey IN (FROM lost) THEN 'installation_id' END]) AS column FROM customer)
WHERE "column" IS NOT NULL GROUP BY "column"
UNION ALL SELECT 'team_members', 'user_id', count(*) FROM gone
UNION ALL SELECT 'invitations', 'invited_by', count(*) FROM customer WHERE c_custkey % 50 IN (FROM gone)
UNION ALL SELECT 'activity_logs', 'user_id', count(*) FROM events WHERE event_type <> 'view' AND user_id IN (FROM gone)""",
)
def c5_blocking(spark, d):
    """Rows that forbid the deletion of users, by the reference that does, cascades to installations included."""
    leaving = table(spark, d, "supplier").filter(F.col("s_nationkey") < 5).select(F.col("s_suppkey").cast("int").alias("id"))
    names = ["users", "github_app_installations", "github_repos", "team_members", "invitations", "activity_logs"]
    shaped = views.catalogue(spark, d)
    effect = integrity.delete({n: shaped[n] for n in names}, "users", leaving)
    held = [rows.select(F.lit(n).alias("name"), F.explode("blocked_by").alias("column")) for n, rows in effect.fates.items()]
    return integrity.union_all(held).groupBy("name", "column").agg(F.count("*").alias("n"))


# --- relations -----------------------------------------------------------------------------------


def _ids(name: str):
    return F.array_join(F.transform(name, lambda m: m["id"].cast("string")), ",").alias("ids")


def _many(parent, child, column, name):
    nested = relations.to_many(parent, child, column, name, ["id"])
    return nested.select(F.col("id").alias("parent_id"), F.lit(name).alias("relation"), "chunk", _ids(name))


def _many_sql(name, parent, key, child, fk, child_id):
    return f"""
SELECT p.{key}::INT AS parent_id, '{name}' AS relation, coalesce(chunk, 0) AS chunk, coalesce(ids, '') AS ids FROM {parent} p
LEFT JOIN (SELECT fk, chunk, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT fk, id, id // {relations.NEST_WIDTH} AS chunk
  FROM (SELECT {fk} AS fk, {child_id} AS id FROM {child})) GROUP BY fk, chunk) c ON c.fk = p.{key}"""


@query(
    "j3a_team_members",
    _many_sql("members", "region", "r_regionkey", "supplier", "s_nationkey % 4", "s_suppkey")
    + " UNION ALL " + _many_sql("logs", "region", "r_regionkey", "events", "user_id % 5", "event_id")
    + " UNION ALL " + _many_sql("invitations", "region", "r_regionkey", "customer", "c_nationkey % 5", "c_custkey"),
)
def j3a(spark, d):
    teams = views.teams(spark, d)
    return integrity.union_all(
        [
            _many(teams, views.team_members(spark, d), "team_id", "members"),
            _many(teams, views.activity_logs(spark, d), "team_id", "logs"),
            _many(teams, views.invitations(spark, d), "team_id", "invitations"),
        ]
    )


@query(
    "j3b_user_invitations",
    _many_sql("members", "supplier", "s_suppkey", "supplier", "s_suppkey", "s_suppkey")
    + " UNION ALL " + _many_sql("sent", "supplier", "s_suppkey", "customer", "c_custkey % 50", "c_custkey"),
)
def j3b(spark, d):
    users = views.users(spark, d)
    return integrity.union_all(
        [
            _many(users, views.team_members(spark, d), "user_id", "members"),
            _many(users, views.invitations(spark, d), "invited_by", "sent"),
        ]
    )


@query(
    "j3c_invitation",
    """
SELECT c_custkey::INT AS id, r_name AS team, s_name AS inviter FROM customer
LEFT JOIN region ON r_regionkey = c_nationkey % 5 LEFT JOIN supplier ON s_suppkey = c_custkey % 50""",
)
def j3c(spark, d):
    rows = relations.to_one(views.invitations(spark, d), "team_id", views.teams(spark, d), "team", ["name"])
    rows = relations.to_one(rows, "invited_by", views.users(spark, d), "inviter", ["name"])
    return rows.select("id", F.col("team.name").alias("team"), F.col("inviter.name").alias("inviter"))


@query(
    "j3d_membership",
    """
SELECT s_suppkey::INT AS id, s_name AS user_name, r_name AS team FROM supplier LEFT JOIN region ON r_regionkey = s_nationkey % 4""",
)
def j3d(spark, d):
    rows = relations.to_one(views.team_members(spark, d), "team_id", views.teams(spark, d), "team", ["name"])
    rows = relations.to_one(rows, "user_id", views.users(spark, d), "user", ["name"])
    return rows.select("id", F.col("user.name").alias("user_name"), F.col("team.name").alias("team"))


@query(
    "j3e_activity_log",
    """
SELECT event_id::INT AS id, upper(event_type) AS action, r_name AS team, s_name AS user_name FROM events
LEFT JOIN region ON r_regionkey = user_id % 5
LEFT JOIN supplier ON s_suppkey = CASE WHEN event_type <> 'view' THEN user_id END""",
)
def j3e(spark, d):
    rows = relations.to_one(views.activity_logs(spark, d), "team_id", views.teams(spark, d), "team", ["name"])
    rows = relations.to_one(rows, "user_id", views.users(spark, d), "user", ["name"])
    return rows.select("id", "action", F.col("team.name").alias("team"), F.col("user.name").alias("user_name"))


@query(
    "j3f_installation",
    """
SELECT p.*, s_name AS user_name FROM (""" + _many_sql(
        "repositories", "nation", "n_nationkey", "customer",
        "CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END", "c_custkey") + ") p LEFT JOIN supplier ON s_suppkey = p.parent_id % 50",
)
def j3f(spark, d):
    rows = relations.to_one(views.installations(spark, d), "user_id", views.users(spark, d), "user", ["name"])
    nested = relations.to_many(rows, views.repos(spark, d), "installation_id", "repositories", ["id"])
    return nested.select(
        F.col("id").alias("parent_id"), F.lit("repositories").alias("relation"), "chunk", _ids("repositories"),
        F.col("user.name").alias("user_name"),
    )


@query(
    "j3g_repository",
    """
SELECT c_custkey::INT AS id, s_name AS user_name, r_name AS team, n_name AS installation FROM customer
LEFT JOIN supplier ON s_suppkey = c_custkey % 50
LEFT JOIN region ON r_regionkey = CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey % 5 END
LEFT JOIN nation ON n_nationkey = CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END""",
)
def j3g(spark, d):
    rows = relations.to_one(views.repos(spark, d), "user_id", views.users(spark, d), "user", ["name"])
    rows = relations.to_one(rows, "team_id", views.teams(spark, d), "team", ["name"])
    rows = relations.to_one(rows, "installation_id", views.installations(spark, d), "installation", ["account_login"])
    return rows.select(
        "id", F.col("user.name").alias("user_name"), F.col("team.name").alias("team"),
        F.col("installation.account_login").alias("installation"),
    )


@query(
    "j3h_team_with_members",
    f"""
SELECT r_regionkey AS team_id, r_name AS team, coalesce(chunk, 0) AS chunk, coalesce(members, '') AS members FROM region
LEFT JOIN (SELECT s_nationkey % 4 AS team_id, s_suppkey // {relations.NEST_WIDTH} AS chunk, string_agg(s_suppkey || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'owner' ELSE 'member' END
  || '/' || s_name || '/' || lower(s_name) || '@example.com', ',' ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1, 2) m
ON m.team_id = r_regionkey""",
)
def j3h(spark, d):
    members = relations.to_one(
        views.team_members(spark, d), "user_id", views.users(spark, d), "user", ["id", "name", "email"]
    )
    nested = relations.to_many(views.teams(spark, d), members, "team_id", "members", ["role", "user"])
    line = lambda m: F.concat_ws(
        "/", m["id"].cast("string"), m["role"], m["user"]["name"], m["user"]["email"]
    )
    return nested.select(
        F.col("id").alias("team_id"), F.col("name").alias("team"), "chunk",
        F.array_join(F.transform("members", line), ",").alias("members"),
    )
