"""Job, credential, download, file and write queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import payload, text
from scanloom.operators import conform, credentials, summary, updates
from scanloom.plans.registry import query
from scanloom.plans.report_sql import COUNTERS, report_sql
from scanloom.session import fresh_path, local_path
from scanloom.sources import files as fs
from scanloom.sources import jobs as job_source
from scanloom.sources import views
from scanloom.sources.tables import table

NOW = f"TIMESTAMP '{views.NOW_TEXT}'"


def job_sql(body: str) -> str:
    """``body`` over msg (messages), job (readable ones), repo, inst and res (resolved jobs)."""
    return f"""
WITH msg AS (
  SELECT event_id, 'scan_' || event_id AS scan_id, (user_id * 11)::INT AS repo_id,
    CASE WHEN event_id % 5 = 0 THEN 'https://github.com/org' || user_id || '/repo' || event_id || '.git'
         WHEN event_id % 5 = 1 THEN 'git@github.com:org/repo' || event_id
         WHEN event_id % 5 = 2 THEN 'https://github.com/org/my.repo'
         WHEN event_id % 5 = 3 THEN 'https://example.com/org/repo'
         WHEN event_type = 'click' THEN '' END AS repo_url,
    CASE event_type WHEN 'click' THEN 'tok' || user_id WHEN 'error' THEN '' END AS token,
    CASE event_type WHEN 'view' THEN CASE WHEN user_id % 30 = 7 THEN 'inst-7' ELSE '' || (1000 + user_id % 30) END
                    WHEN 'error' THEN '' END AS installation_id,
    CASE WHEN value > 150 THEN 'bad_json' WHEN value > 100 THEN 'no_job' END AS parse_error
  FROM events),
job AS (SELECT * FROM msg WHERE parse_error IS NULL),
inst AS (
  SELECT n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 'inst-7' ELSE '' || (1000 + n_nationkey) END AS installation_id,
    n_name AS account_login, CASE WHEN n_nationkey % 6 <> 0 THEN 'cached' || n_nationkey END AS access_token,
    n_nationkey AS minutes FROM nation),
repo AS (
  SELECT c_custkey::INT AS id, c_name AS name, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS installation_key
  FROM customer),
full_repo AS (SELECT r.id AS repo_id, r.name AS repo_name, i.installation_id AS installation_ref, i.account_login
              FROM repo r LEFT JOIN inst i ON r.installation_key = i.id),
src AS (
  SELECT j.*, f.repo_name, CASE WHEN token <> '' THEN 'job_token' WHEN j.installation_id <> '' THEN 'job_installation'
    WHEN f.installation_ref IS NOT NULL THEN 'repo_installation' ELSE 'public' END AS auth_source,
    CASE WHEN token <> '' THEN NULL WHEN j.installation_id <> '' THEN j.installation_id
      ELSE f.installation_ref END AS auth_ref
  FROM job j LEFT JOIN full_repo f USING (repo_id)),
res AS (
  SELECT s.*, CASE WHEN auth_source = 'job_token' THEN 'given' WHEN auth_source = 'public' THEN 'none'
    WHEN i.id IS NULL THEN 'not_found' WHEN i.access_token IS NOT NULL AND i.minutes > 5 THEN 'cached'
    WHEN auth_ref = 'inst-7' THEN 'invalid_id' ELSE 'refresh' END AS token_state
  FROM src s LEFT JOIN inst i ON s.auth_ref = i.installation_id),
err AS (
  SELECT *, CASE WHEN token_state = 'not_found' THEN '{K.ERR_NO_INSTALLATION}' || auth_ref
    WHEN token_state = 'invalid_id' THEN '{K.ERR_BAD_INSTALLATION}' || auth_ref
    WHEN event_id % 5 = 4 THEN '{K.ERR_NO_URL}' WHEN event_id % 5 = 3 THEN '{K.ERR_BAD_URL}' END AS error
  FROM res)
{body}
"""


def _jobs(spark, d):
    return job_source.readable(views.jobs(spark, d))


def _resolved(spark, d):
    return credentials.resolve(_jobs(spark, d), views.repos(spark, d), views.installations(spark, d), views.now())


@query(
    "s1_job_source",
    job_sql("""
SELECT event_id, scan_id, repo_id, repo_url, token, installation_id, NULL AS parse_error FROM job
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, parse_error FROM msg WHERE parse_error IS NOT NULL"""),
)
def s1(spark, d):
    return views.jobs(spark, d).drop("body", "arrival", "branch")


@query(
    "s3_table_source",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL",
)
def s3(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    )


@query(
    "e7_missing_url",
    job_sql("""
SELECT event_id, CASE WHEN parse_error IS NOT NULL THEN parse_error ELSE 'no_url' END AS reason
FROM msg WHERE parse_error IS NOT NULL OR event_id % 5 = 4"""),
)
def e7(spark, d):
    return job_source.dead_letters(views.jobs(spark, d)).select("event_id", "reason")


@query(
    "j1_job_repo_installation",
    job_sql("""
SELECT event_id, repo_id, repo_name, installation_ref, account_login FROM job LEFT JOIN full_repo USING (repo_id)"""),
)
def j1(spark, d):
    full = credentials.job_includes(_jobs(spark, d), views.repos(spark, d), views.installations(spark, d))
    return full.select("event_id", "repo_id", "repo_name", "installation_ref", "account_login")


@query(
    "j1b_credential_source",
    job_sql("SELECT event_id, auth_source, auth_ref, token_state, error FROM err"),
)
def j1b(spark, d):
    return _resolved(spark, d).select("event_id", "auth_source", "auth_ref", "token_state", "error")


@query(
    "j2_installation_lookup",
    job_sql("""
SELECT event_id, j.installation_id, i.id AS found_id, i.access_token AS found_token
FROM job j LEFT JOIN inst i ON j.installation_id = i.installation_id"""),
)
def j2(spark, d):
    found = credentials.installation_lookup(
        _jobs(spark, d), views.installations(spark, d), "installation_id", "scan_id"
    )
    return found.select("event_id", "installation_id", "found_id", "found_token")


@query(
    "f2_key_lookup",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3)""",
)
def f2(spark, d):
    """Equality with one key: the key's value becomes a runtime filter of the scan."""
    key = table(spark, d, "customer").filter(F.col("c_nationkey") == 3).agg(F.min("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(key, "o_custkey", "left_semi").select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


@query(
    "f3_token_valid",
    """
SELECT event_id, event_type NOT IN ('error', 'view') AND event_id % 11 > 5 AND event_type <> 'signup' AS valid FROM events""",
)
def f3(spark, d):
    kind = F.col("event_type")
    token = F.when(kind == "error", "").when(kind != "view", F.concat(F.lit("tok"), F.col("user_id").cast("string")))
    expires = F.when(kind != "signup", F.timestamp_add("MINUTE", (F.col("event_id") % 11).cast("int"), F.col("ts")))
    return table(spark, d, "events").select(
        "event_id", text.token_valid(token, expires, F.col("ts")).alias("valid")
    )


@query(
    "f7_unmatched_reference",
    job_sql("SELECT event_id, installation_id FROM err WHERE token_state = 'not_found'"),
)
def f7(spark, d):
    return credentials.unmatched_references(_jobs(spark, d), views.installations(spark, d)).select(
        "event_id", "installation_id"
    )


@query(
    "p13_repo_url",
    job_sql("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN regexp_replace(split_part(repo_url, '/', 4), '^$', '') WHEN 1 THEN 'org'
    WHEN 2 THEN 'org' END AS owner,
  CASE WHEN event_id % 5 < 2 THEN 'repo' || event_id WHEN event_id % 5 = 2 THEN 'my' END AS repo FROM job"""),
)
def p13(spark, d):
    url = F.col("repo_url")
    return _jobs(spark, d).select("event_id", text.repo_owner(url).alias("owner"), text.repo_name(url).alias("repo"))


@query(
    "p14_archive_url",
    job_sql("""
, u AS (SELECT event_id, token, CASE event_id % 5 WHEN 0 THEN split_part(repo_url, '/', 4) || '/repo' || event_id
    WHEN 1 THEN 'org/repo' || event_id WHEN 2 THEN 'org/my' END AS full_name FROM job)
SELECT event_id, CASE WHEN token <> '' THEN 'https://api.github.com/repos/' || full_name || '/zipball/main'
  ELSE 'https://github.com/' || full_name || '/archive/refs/heads/main.zip' END AS url FROM u"""),
)
def p14(spark, d):
    url = F.col("repo_url")
    built = text.archive_url(text.repo_owner(url), text.repo_name(url), F.col("branch"), F.col("token"))
    return _jobs(spark, d).select("event_id", built.alias("url"))


_PAYLOAD = """
WITH raw AS (
  SELECT 'page' AS kind, page_id AS id, html AS body FROM pages
  UNION ALL SELECT 'document', doc_id, text FROM documents),
p AS (
  SELECT kind, id, CASE id % 5 WHEN 0 THEN octet_length(encode(body)) WHEN 1 THEN octet_length(encode(body)) + 2
      WHEN 2 THEN 0 WHEN 4 THEN (id % 7) * 1073741824 + 4 END AS size,
    CASE WHEN id % 5 = 0 THEN body END AS plain FROM raw),
c AS (
  SELECT *, CASE WHEN id % 4 > 1 THEN 'http_error' WHEN id % 5 = 3 THEN 'missing' WHEN size = 0 THEN 'empty'
    WHEN size > 5368709120 THEN 'too_large' WHEN id % 5 = 0 AND NOT starts_with(plain, 'PK') THEN 'not_zip'
    ELSE 'ok' END AS class FROM p)
"""


@query("p15_payload_class", _PAYLOAD + "SELECT kind, id, class FROM c")
def p15(spark, d):
    return views.payloads(spark, d).select(
        "kind", "id", payload.payload_class(F.col("http_code"), F.col("size"), F.col("content")).alias("class")
    )


@query(
    "s6_payload_check",
    _PAYLOAD
    + """
SELECT class, count(*) AS n,
  count(*) FILTER (class = 'not_zip' AND (contains(plain[:200], '<!DOCTYPE') OR contains(plain[:200], '<html'))) AS n_html,
  max(CASE WHEN class = 'too_large' THEN floor(size / 1048576.0 + 0.5) END)::BIGINT AS max_mib FROM c GROUP BY class""",
)
def s6(spark, d):
    kind = payload.payload_class(F.col("http_code"), F.col("size"), F.col("content"))
    judged = views.payloads(spark, d).select(
        kind.alias("class"), payload.looks_like_html(F.col("content")).alias("html"), payload.size_mib(F.col("size")).alias("mib")
    )
    return judged.groupBy("class").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("class") == "not_zip") & F.col("html")).alias("n_html"),
        F.max(F.when(F.col("class") == "too_large", F.col("mib"))).alias("max_mib"),
    )


@query("p16_scan_duration", "SELECT event_id, event_id % 7919 * 13 AS duration_ms FROM events")
def p16(spark, d):
    took = F.timestamp_add("MILLISECOND", (F.col("event_id") % 7919 * 13).cast("int"), F.col("ts"))
    return table(spark, d, "events").select("event_id", text.duration_ms(F.col("ts"), took).alias("duration_ms"))


@query("p17_minutes_to_expiry", "SELECT event_id, (event_id % 300 * 10 + 30) // 60 AS minutes FROM events")
def p17(spark, d):
    expires = F.timestamp_add("SECOND", (F.col("event_id") % 300 * 10).cast("int"), F.col("ts"))
    return table(spark, d, "events").select("event_id", text.minutes_until(expires, F.col("ts")).alias("minutes"))


_FILES = """
WITH f AS (SELECT doc_id, text, source || '/' || ['', 'node_modules/', '.git/', '.github/', 'sub/node_modules/', '', '_x/',
  '', '', ''][doc_id % 10 + 1] || lang || '/' || CASE doc_id % 10 WHEN 5 THEN 'node_modules' WHEN 7 THEN '.env'
  ELSE doc_id || '.txt' END AS path FROM documents)
"""


@query(
    "p19_archive_root",
    _FILES + "SELECT doc_id, path AS path FROM f",
)
def p19(spark, d):
    wrapped = F.concat(F.lit("repo-main/"), F.col("path"))
    return views.files(spark, d).select("doc_id", text.strip_archive_root(wrapped).alias("path"))


@query("s4_file_listing", _FILES + "SELECT path, count(*) AS n FROM f WHERE doc_id % 10 NOT IN (1, 2, 4) GROUP BY path")
def s4(spark, d):
    """Listing rule over a path table; ``walk_files`` applies the same rule to real directories."""
    kept = views.files(spark, d).filter(fs.outside(F.col("path"), views.SKIP_DIRS))
    return kept.groupBy("path").agg(F.count("*").alias("n"))


@query(
    "s5_file_text",
    _FILES + "SELECT doc_id, length(text) + 1 AS n_chars, md5(text || chr(65533)) AS digest FROM f",
)
def s5(spark, d):
    content = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff"))
    decoded = views.files(spark, d).select("doc_id", text.utf8_text(content).alias("body"))
    return decoded.select(
        "doc_id", F.length("body").cast("bigint").alias("n_chars"), F.md5(F.encode("body", "UTF-8")).alias("digest")
    )


_TREE = """
WITH f AS (SELECT doc_id, source || '/' || ['', 'node_modules/', '.git/', '.github/', 'sub/node_modules/', '', '_x/', '', '', ''][doc_id % 10 + 1]
    || lang || '/' || doc_id || '/' || CASE doc_id % 10 WHEN 5 THEN 'node_modules' WHEN 7 THEN '.env' ELSE doc_id || '.txt' END AS path, text
  FROM documents WHERE text IS NOT NULL)
"""


def _tree(spark, d):
    """The documents as files of a real tree in the shared folder, one folder each; the tree's root as a row."""
    root = local_path(fresh_path(spark, "tree"))
    apart = F.regexp_replace("path", "([^/]+)$", F.concat(F.col("doc_id").cast("string"), F.lit("/$1")))
    fs.write_files(views.files(spark, d).select(F.lit(root).alias("root"), apart.alias("path"), "text"))
    return spark.range(1).select(F.lit(root).alias("root"))


@query(
    "s4_tree_listing",
    _TREE + "SELECT path, strlen(text)::BIGINT AS size FROM f WHERE doc_id % 10 NOT IN (1, 2, 4)",
)
def s4_tree(spark, d):
    return fs.walk_files(_tree(spark, d), views.SKIP_DIRS).select("path", "size")


@query("s5_tree_text", _TREE + "SELECT path, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM f")
def s5_tree(spark, d):
    read = fs.file_texts(fs.walk_files(_tree(spark, d)))
    return read.select("path", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "f4_directory_exclusion",
    _FILES + """
SELECT split_part(path, '/', 1) AS source, count(*) AS n_files, count(*) FILTER (doc_id % 10 IN (1, 2, 4)) AS n_skipped
FROM f GROUP BY 1""",
)
def f4(spark, d):
    skipped = ~fs.outside(F.col("path"), views.SKIP_DIRS)
    return (
        views.files(spark, d)
        .groupBy(F.substring_index("path", "/", 1).alias("source"))
        .agg(F.count("*").alias("n_files"), F.count_if(skipped).alias("n_skipped"))
    )


@query(
    "f5_retention",
    "SELECT event_id, ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR AS expired FROM events",
)
def f5(spark, d):
    at = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    return table(spark, d, "events").select("event_id", fs.expired(F.col("ts"), at).alias("expired"))


@query(
    "f6_severity_equality",
    report_sql("SELECT scan_id, tool, pos FROM iss WHERE severity = 'info'"),
)
def f6(spark, d):
    issues = conform.all_issues(views.reports(spark, d))
    return issues.filter(F.col("severity") == "info").select("scan_id", "tool", "pos")


# --- writes ---------------------------------------------------------------------------------------


@query(
    "k1_append_issues",
    report_sql("""
SELECT scan_id, tool, severity, title, file_path, line_start, line_end, coalesce(cwe, '') AS cwe,
  coalesce(owasp, '') AS owasp, 'open' AS status, pos FROM iss
WHERE scan_id NOT IN (
  SELECT scan_id FROM iss
  WHERE severity IS NULL OR title IS NULL OR description IS NULL OR file_path IS NULL OR line_start IS NULL)"""),
)
def k1(spark, d):
    """Scans that an issue fails store nothing. The batch is delivered twice; the second write replaces the first."""
    path = fresh_path(spark, "issues")
    issues = conform.sink_rows(conform.all_issues(views.reports(spark, d)), views.now())
    rows = updates.staged_issues(issues, _scan_rows(spark, d))
    for _ in range(2):
        updates.write_batch(rows, path, "2024-01-01T00", placed=True)
    return updates.read_batches(spark, path).select(
        "scan_id", "tool", "severity", "title", "file_path", "line_start", "line_end",
        F.array_join("cwe", ",").alias("cwe"), F.array_join("owasp", ",").alias("owasp"), "status", "pos",
    )


def _scan_rows(spark, d):
    """Stored scans with the counters' declared defaults."""
    zero = F.lit(0)
    return views.scans(spark, d).select(
        "scan_id", "repo_id", "status", F.lit(None).cast("array<string>").alias("tools_used"),
        F.lit(None).cast("int").alias("scan_duration"), zero.alias("total_issues"),
        *[zero.alias(c) for c in summary.COUNTERS], F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )


def _completion(spark, d, issues):
    took = F.length("scan_id") * 1000
    counted = summary.scan_summary(views.scans(spark, d), issues)
    return updates.completion(counted, views.requested_tools(spark, d), took, views.now())


_COUNTED = f"""
, counted AS (SELECT s.scan_id, {COUNTERS} FROM (SELECT 'scan_' || o_orderkey AS scan_id FROM orders) s
  LEFT JOIN iss USING (scan_id) GROUP BY s.scan_id),
tools_of AS (SELECT scan_id, string_agg(tool, ',' ORDER BY t) AS tools_used FROM asked GROUP BY scan_id),
stop AS (SELECT scan_id, bool_or(file_path IS NULL) AS no_path,
  bool_or(file_path IS NULL OR title IS NULL OR description IS NULL) AS bad FROM iss GROUP BY scan_id)
"""


@query(
    "k2_complete_scan",
    report_sql(_COUNTED + """
SELECT scan_id, 'completed' AS status, tools_used, length(scan_id) * 1000 AS scan_duration, total_issues, critical_count,
  high_count, medium_count, low_count, info_count FROM counted JOIN tools_of USING (scan_id)"""),
)
def k2(spark, d):
    done = _completion(spark, d, conform.all_issues(views.reports(spark, d)))
    closed = updates.keyed_update(_scan_rows(spark, d), done, "scan_id", updates.COMPLETED)
    return closed.select(
        "scan_id", "status", F.array_join("tools_used", ",").alias("tools_used"),
        *[F.col(c).cast("bigint").alias(c) for c in ("scan_duration", "total_issues", *summary.COUNTERS)],
    )


@query(
    "k3_fail_scan",
    """
SELECT 'scan_' || o_orderkey AS scan_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
  WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN '2024-01-01 00:10:00' END AS completed_at FROM orders""",
)
def k3(spark, d):
    failing = table(spark, d, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    failed = updates.failure(failing.select(views.scan_id(F.col("o_orderkey")).alias("scan_id")), views.now())
    closed = updates.keyed_update(_scan_rows(spark, d), failed, "scan_id", updates.FAILED)
    return closed.select("scan_id", "status", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query(
    "k2_k3_failed_with_counts",
    report_sql(_COUNTED + """
SELECT scan_id, CASE WHEN coalesce(bad, false) THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN coalesce(no_path, false) THEN 0 ELSE total_issues END AS total_issues,
  CASE WHEN coalesce(no_path, false) THEN 0 ELSE critical_count END AS critical_count
FROM counted LEFT JOIN stop USING (scan_id)"""),
)
def k23(spark, d):
    issues = conform.all_issues(views.reports(spark, d))
    scans = _scan_rows(spark, d)
    closing = updates.closing(scans, issues, views.requested_tools(spark, d), F.length("scan_id") * 1000, views.now())
    closed = updates.close_scans(scans, closing)
    return closed.select(
        "scan_id", "status", *[F.col(c).cast("bigint").alias(c) for c in ("total_issues", "critical_count")]
    )


@query(
    "k4_refresh_credential",
    job_sql("""
, used AS (SELECT DISTINCT auth_ref FROM res WHERE token_state = 'refresh')
SELECT i.id, CASE WHEN u.auth_ref IS NOT NULL THEN 'fresh-' || i.installation_id ELSE i.access_token END AS access_token,
  CASE WHEN u.auth_ref IS NOT NULL THEN 60 ELSE i.minutes END::BIGINT AS minutes, u.auth_ref IS NOT NULL AS touched
FROM inst i LEFT JOIN used u ON i.installation_id = u.auth_ref"""),
)
def k4(spark, d):
    issued = (
        _resolved(spark, d)
        .filter(F.col("token_state") == "refresh")
        .groupBy(F.col("found_id").alias("id"))
        .agg(F.max(F.concat(F.lit("fresh-"), F.col("auth_ref"))).alias("access_token"))
        .withColumn("token_expires_at", F.timestamp_add("HOUR", F.lit(1), views.now()))
    )
    stored = updates.refresh_credentials(views.installations(spark, d), issued, views.now())
    return stored.select(
        "id", "access_token", text.minutes_until(F.col("token_expires_at"), views.now()).alias("minutes"),
        F.col("updated_at").isNotNull().alias("touched"),
    )


@query(
    "k5_job_outcome",
    job_sql("""
SELECT event_id, CASE WHEN error IS NULL THEN '{"success":true,"scanId":"' || scan_id || '"}'
  ELSE '{"error":"' || error || '"}' END AS reply FROM err"""),
)
def k5(spark, d):
    return _resolved(spark, d).select(
        "event_id", credentials.outcome(F.col("scan_id"), F.col("error")).alias("reply")
    )


@query(
    "o2_first_by_key",
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def o2(spark, d):
    """First row by key without sorting a key's rows: a minimum needs no window and combines map-side."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", "first.*")
