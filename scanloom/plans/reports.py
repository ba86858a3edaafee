"""Report queries: sources, normalisers, scalar maps, union, numbering, summaries, error rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import severity as sev
from scanloom.functions import text
from scanloom.operators import conform, ordinals, summary
from scanloom.plans.registry import query
from scanloom.plans.report_sql import COUNTERS, ISSUE_COLUMNS, report_sql
from scanloom.sources import reports as src
from scanloom.sources import views
from scanloom.sources.tables import table


def flat(issues):
    """Lists as text, so that any engine can compare them."""
    rest = [c for c in issues.columns if c not in ("cwe", "owasp", "tool_rank")]
    return issues.select(*rest, F.array_join("cwe", ",").alias("cwe"), F.array_join("owasp", ",").alias("owasp"))


def findings(spark, d, tool):
    return src.explode_findings(src.read_reports(views.reports(spark, d)[tool], conform.REGISTRY[tool].dialect))


# --- sources -----------------------------------------------------------------------------------


def _rule_source(tool, rank):
    cwe = """CASE WHEN k % 4 <> 3 AND k % 3 = 0 THEN '["CWE-79","CWE-89"]' END""" if rank == 0 else (
        "CASE WHEN k % 4 <> 3 THEN 'CWE-20' END")

    @query(
        f"s2{'ab'[rank]}_{tool}_source",
        report_sql(f"""
SELECT scan_id, i AS pos, CASE WHEN k % 401 <> 0 THEN 'rule.' || (k % 13) END AS check_id,
  CASE WHEN k % 389 = 0 THEN NULL WHEN k % 4 < 2 THEN root || '/' || base
       WHEN k % 4 = 2 THEN root || '/nested' || root || '/' || base ELSE base END AS path,
  line AS start_line, line + i AS end_line, 'finding ' || k AS message,
  ['ERROR', 'critical', 'Warning', 'INFO', 'EXPERIMENT'][k % 5 + 1] AS severity,
  {cwe} AS cwe, CASE WHEN k % 4 <> 3 AND k % 2 = 0 THEN '["A03:2021"]' END AS owasp,
  CASE k % 4 WHEN 0 THEN 'sql-injection' WHEN 1 THEN 'xss-reflected' WHEN 2 THEN 'crypto-weak' END AS category
FROM usable WHERE t = {rank}"""),
    )
    def run(spark, d):
        return findings(spark, d, tool).select(
            "scan_id",
            "pos",
            "f.check_id",
            "f.path",
            F.col("f.start.line").alias("start_line"),
            F.col("f.end.line").alias("end_line"),
            "f.extra.message",
            "f.extra.severity",
            "f.extra.metadata.cwe",
            "f.extra.metadata.owasp",
            "f.extra.metadata.category",
        )


_rule_source("semgrep", 0)
_rule_source("opengrep", 1)

_RAW_PATH = """CASE WHEN k % 389 = 0 THEN NULL WHEN k % 4 < 2 THEN root || '/' || base
       WHEN k % 4 = 2 THEN root || '/nested' || root || '/' || base ELSE base END"""


@query(
    "s2c_gitleaks_source",
    report_sql(f"""
SELECT scan_id, i AS pos, CASE WHEN k % 401 <> 0 THEN 'secret ' || k END AS description, line AS start_line,
  line + i AS end_line, {_RAW_PATH} AS file, 'k' || k || 'x' || o_orderkey AS secret,
  CASE WHEN k % 11 <> 0 THEN 'rule-' || (k % 7) END AS rule_id
FROM usable WHERE t = 2"""),
)
def s2c(spark, d):
    return findings(spark, d, "gitleaks").select(
        "scan_id",
        "pos",
        F.col("f.Description").alias("description"),
        F.col("f.StartLine").alias("start_line"),
        F.col("f.EndLine").alias("end_line"),
        F.col("f.File").alias("file"),
        F.col("f.Secret").alias("secret"),
        F.col("f.RuleID").alias("rule_id"),
    )


@query(
    "s2d_checkov_source",
    report_sql(f"""
SELECT scan_id, i AS pos, 'CKV_' || (k % 31) AS check_id,
  CASE WHEN k % 401 <> 0 THEN 'check ' || (k % 17) END AS check_name, {_RAW_PATH} AS file_path,
  line AS first_line, line + i AS last_line, CASE WHEN k % 13 <> 0 THEN 'res.' || k END AS resource,
  ['policy.CRITICAL.x', 'policy.HIGH.x', 'policy.MEDIUM.x', 'policy.ALLOW.x', 'policy.other'][k % 5 + 1] AS check_class,
  CASE k % 3 WHEN 0 THEN 'https://guide/' || k WHEN 1 THEN '' END AS guideline
FROM usable WHERE t = 3"""),
)
def s2d(spark, d):
    return findings(spark, d, "checkov").select(
        "scan_id",
        "pos",
        "f.check_id",
        "f.check_name",
        "f.file_path",
        F.get("f.file_line_range", F.lit(0)).alias("first_line"),
        F.get("f.file_line_range", F.lit(1)).alias("last_line"),
        "f.resource",
        "f.check_class",
        "f.guideline",
    )


@query(
    "s2e_trivy_source",
    report_sql(f"""
SELECT scan_id, i AS pos, {_RAW_PATH} AS target, 'CVE-' || k AS vulnerability_id, 'pkg' || (k % 29) AS pkg_name,
  '1.' || (k % 10) AS installed_version, CASE k % 3 WHEN 0 THEN '2.' || (k % 10) WHEN 1 THEN '' END AS fixed_version,
  ['CRITICAL', 'high', 'Medium', 'LOW', 'UNKNOWN'][k % 5 + 1] AS severity,
  CASE WHEN k % 4 = 0 THEN '' WHEN k % 401 <> 0 THEN 'vuln ' || k END AS title
FROM usable WHERE t = 4"""),
)
def s2e(spark, d):
    return findings(spark, d, "trivy").select(
        "scan_id",
        "pos",
        F.col("f.Target").alias("target"),
        F.col("f.vuln.VulnerabilityID").alias("vulnerability_id"),
        F.col("f.vuln.PkgName").alias("pkg_name"),
        F.col("f.vuln.InstalledVersion").alias("installed_version"),
        F.col("f.vuln.FixedVersion").alias("fixed_version"),
        F.col("f.vuln.Severity").alias("severity"),
        F.col("f.vuln.Title").alias("title"),
    )


# --- normalisers -------------------------------------------------------------------------------


def _normaliser(name, tool, rank):
    @query(name, report_sql(f"SELECT {ISSUE_COLUMNS} FROM iss WHERE tool_rank = {rank}"))
    def run(spark, d):
        return flat(conform.tool_issues(views.reports(spark, d), tool))


for _i, _tool in enumerate(K.TOOLS):
    _normaliser(f"p{_i + 1}_{_tool}_issue", _tool, _i)


@query(
    "p6a_severity_semgrep",
    """
SELECT l_orderkey, l_partkey, l_linenumber,
  ['critical', 'critical', 'high', 'medium', 'low'][l_partkey % 5 + 1] AS severity FROM lineitem""",
)
def p6a(spark, d):
    level = views.pick(views.RULE_LEVELS, F.col("l_partkey") % 5)
    return _line(spark, d).select(
        "l_orderkey", "l_partkey", "l_linenumber", sev.rule_severity(level).alias("severity")
    )


@query(
    "p6b_severity_checkov",
    """
SELECT l_orderkey, l_partkey, l_linenumber,
  ['critical', 'high', 'medium', 'low', 'medium'][l_partkey % 5 + 1] AS severity FROM lineitem""",
)
def p6b(spark, d):
    level = views.pick(views.POLICY_CLASSES, F.col("l_partkey") % 5)
    return _line(spark, d).select(
        "l_orderkey", "l_partkey", "l_linenumber", sev.policy_severity(level).alias("severity")
    )


@query(
    "p6c_severity_trivy",
    """
SELECT l_orderkey, l_partkey, l_linenumber,
  ['critical', 'high', 'medium', 'low', 'info'][l_partkey % 5 + 1] AS severity FROM lineitem""",
)
def p6c(spark, d):
    level = views.pick(views.PACKAGE_LEVELS, F.col("l_partkey") % 5)
    return _line(spark, d).select(
        "l_orderkey", "l_partkey", "l_linenumber", sev.package_severity(level).alias("severity")
    )


@query("p6d_severity_gitleaks", "SELECT l_orderkey, l_partkey, l_linenumber, 'critical' AS severity FROM lineitem")
def p6d(spark, d):
    return _line(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", sev.secret_severity().alias("severity"))


def _line(spark, d):
    return table(spark, d, "lineitem")


@query(
    "p7_recommendation",
    f"""
SELECT l_orderkey, l_suppkey, l_linenumber, CASE l_suppkey % 4
  WHEN 0 THEN '{K.RULE_ADVICE[0][1]}' WHEN 1 THEN '{K.RULE_ADVICE[1][1]}'
  WHEN 2 THEN '{K.RULE_ADVICE[2][1]}' ELSE '{K.RULE_ADVICE_DEFAULT}' END AS recommendation FROM lineitem""",
)
def p7(spark, d):
    category = views.pick(views.CATEGORIES, F.col("l_suppkey") % 4)
    return _line(spark, d).select(
        "l_orderkey", "l_suppkey", "l_linenumber", sev.rule_advice(category).alias("recommendation")
    )


@query(
    "p8_secret_mask",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, 'k' || l_partkey || 'x' || l_suppkey AS secret FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN length(secret) <= 8 THEN '***'
  ELSE substr(secret, 1, 4) || '***' || right(secret, 4) END AS code FROM s""",
)
def p8(spark, d):
    secret = F.concat(F.lit("k"), F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_suppkey").cast("string"))
    return _line(spark, d).select("l_orderkey", "l_linenumber", text.mask_secret(secret).alias("code"))


@query(
    "p9_template",
    """
SELECT l_orderkey, l_linenumber, 'Update ' || coalesce(CASE WHEN l_linestatus = 'F' THEN 'pkg' || l_partkey END, 'undefined')
  || ' from ' || coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'undefined') AS message FROM lineitem""",
)
def p9(spark, d):
    name = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("pkg"), F.col("l_partkey").cast("string")))
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return _line(spark, d).select(
        "l_orderkey", "l_linenumber", text.template("Update ", name, " from ", flag).alias("message")
    )


@query(
    "p10_falsy_default",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'title ' || l_partkey
  WHEN l_linestatus = 'F' THEN 'description ' || l_suppkey END AS description FROM lineitem""",
)
def p10(spark, d):
    flag = F.col("l_returnflag")
    title = F.when(flag == "A", F.concat(F.lit("title "), F.col("l_partkey").cast("string"))).when(flag == "R", "")
    other = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("description "), F.col("l_suppkey").cast("string")))
    return _line(spark, d).select("l_orderkey", "l_linenumber", text.falsy_or(title, other).alias("description"))


@query(
    "p11_array_default",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'CWE-' || l_partkey || ',CWE-' || l_suppkey ELSE '' END AS cwe,
  CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS n FROM lineitem""",
)
def p11(spark, d):
    flag = F.col("l_returnflag")
    pair = F.array(*[F.concat(F.lit("CWE-"), F.col(c).cast("string")) for c in ("l_partkey", "l_suppkey")])
    raw = F.when(flag == "A", F.to_json(pair)).when(flag == "R", F.lit("CWE-1"))
    rows = _line(spark, d).select("l_orderkey", "l_linenumber", text.string_list(raw).alias("list"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("list", ",").alias("cwe"), F.size("list").alias("n"))


@query(
    "p12_strip_root",
    """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 2 THEN 'nested/' ELSE '' END || 'src/' || l_suppkey || '.txt'
  || CASE l_linenumber % 4 WHEN 3 THEN '/tmp/scan/scan_' || l_orderkey ELSE '' END AS file_path FROM lineitem""",
)
def p12(spark, d):
    root = views.scan_root(F.col("l_orderkey"))
    base = F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"), F.lit(".txt"))
    kind = F.col("l_linenumber") % 4
    path = (
        F.when(kind == 0, base)
        .when(kind == 1, F.concat(root, F.lit("/"), base))
        .when(kind == 2, F.concat(root, F.lit("/nested"), root, F.lit("/"), base))
        # A third mention survives: one goes with its slash, one without.
        .otherwise(F.concat(root, F.lit("/"), base, root, root))
    )
    return _line(spark, d).select("l_orderkey", "l_linenumber", text.strip_root(path, root).alias("file_path"))


@query(
    "p18_sink_columns",
    report_sql("""
SELECT scan_id, tool, severity, title, description, file_path, line_start, line_end, code, recommendation,
  coalesce(cwe, '') AS cwe, coalesce(owasp, '') AS owasp, 'open' AS status,
  strftime(TIMESTAMP '2024-01-01 00:10:00', '%Y-%m-%d %H:%M:%S') AS created_at, pos FROM iss"""),
)
def p18(spark, d):
    rows = flat(conform.sink_rows(conform.all_issues(views.reports(spark, d)), views.now()))
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# --- selection, union, numbering ----------------------------------------------------------------


@query(
    "f1_tool_selection",
    report_sql("SELECT scan_id, string_agg(tool, ',' ORDER BY t) AS tools FROM asked GROUP BY scan_id"),
)
def f1(spark, d):
    return views.requested_tools(spark, d).select("scan_id", F.array_join("tools", ",").alias("tools"))


@query("u1_union_all", report_sql("SELECT tool, severity, count(*) AS n FROM iss GROUP BY tool, severity"))
def u1(spark, d):
    return conform.all_issues(views.reports(spark, d)).groupBy("tool", "severity").agg(F.count("*").alias("n"))


@query(
    "o1_issue_ordinal",
    report_sql("""
SELECT scan_id, tool, pos, title,
  row_number() OVER (PARTITION BY scan_id ORDER BY tool_rank, pos)::INT AS ordinal FROM iss"""),
)
def o1(spark, d):
    numbered = ordinals.numbered_issues(views.reports(spark, d), fields=("tool", "title"))
    return numbered.select("scan_id", "tool", "pos", "title", "ordinal")


@query(
    "x1_registry",
    report_sql("""
SELECT scan_id, pos, tool, severity, title, description, file_path, line_start FROM iss WHERE tool_rank = 2
UNION ALL
SELECT 'scan_' || l_orderkey, l_linenumber - l_linenumber, 'llm',
  CASE WHEN l_quantity >= 25 THEN 'high' ELSE 'low' END, 'line ' || l_partkey, 'supplier ' || l_suppkey,
  'src/' || l_suppkey || '.txt', l_linenumber FROM lineitem"""),
)
def x1(spark, d):
    """One more scanner takes a dialect and a normaliser; the rest of the pipeline is unchanged."""
    note_type = "STRUCT<title: STRING, text: STRING, file: STRING, line: INT, level: STRING>"
    notes = src.Dialect(
        document=f"STRUCT<notes: ARRAY<{note_type}>>",
        finding=note_type,
        findings=lambda doc: doc["notes"],
        unusable=lambda f: f.isNull() | f["level"].isNull(),
    )

    def normalise(f):
        return {
            "severity": f["level"],
            "title": f["title"],
            "description": f["text"],
            "file_path": f["file"],
            "line_start": f["line"],
        }

    root = views.scan_root(F.col("l_orderkey"))
    note = F.struct(
        F.concat(F.lit("line "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("text"),
        F.concat(root, F.lit("/src/"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("file"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") >= 25, "high").otherwise("low").alias("level"),
    )
    extra = _line(spark, d).select(
        views.scan_id(F.col("l_orderkey")).alias("scan_id"),
        F.lit("llm").alias("tool"),
        root.alias("scan_root"),
        F.lit(0).alias("exit_code"),
        F.lit(None).cast("string").alias("signal"),
        F.to_json(F.struct(F.array(note).alias("notes"))).alias("stdout"),
    )
    both = src.union_all([views.reports(spark, d)["gitleaks"], extra])
    registry = conform.extended("llm", notes, normalise)
    issues = conform.all_issues(both, tools=["gitleaks", "llm"], registry=registry)
    return issues.select("scan_id", "pos", "tool", "severity", "title", "description", "file_path", "line_start")


# --- summaries ---------------------------------------------------------------------------------


@query(
    "g1_scan_summary",
    report_sql(f"""
SELECT s.scan_id, {COUNTERS}
FROM (SELECT 'scan_' || o_orderkey AS scan_id FROM orders) s LEFT JOIN iss USING (scan_id) GROUP BY s.scan_id"""),
)
def g1(spark, d):
    return summary.scan_summary(views.scans(spark, d), conform.all_issues(views.reports(spark, d)))


def _split_sql(mode):
    usable = "l_partkey % 97 <> 0" if mode == "quarantine" else (
        "l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 97 = 0)")
    return f"""
WITH iss AS (SELECT 'scan_' || l_orderkey AS scan_id, ['critical', 'critical', 'high', 'medium', 'low'][l_partkey % 5 + 1] AS severity
  FROM lineitem WHERE {usable})
SELECT s.scan_id, {COUNTERS} FROM (SELECT 'scan_' || o_orderkey AS scan_id FROM orders) s LEFT JOIN iss USING (scan_id) GROUP BY s.scan_id"""


def _split_summary(mode):
    @query(f"g1_split_reports_{mode}", _split_sql(mode))
    def run(spark, d):
        """One finding per row: every line item is a finding of its order's scan."""
        part = F.col("l_partkey")
        finding = F.to_json(
            F.struct(
                F.lit("rule").alias("check_id"),
                F.concat(F.lit("src/"), F.col("l_suppkey").cast("string")).alias("path"),
                F.struct(F.col("l_linenumber").alias("line")).alias("start"),
                F.struct(F.col("l_linenumber").alias("line")).alias("end"),
                F.struct(
                    F.lit("m").alias("message"),
                    F.when(part % 97 != 0, views.pick(views.RULE_LEVELS, part % 5)).alias("severity"),
                ).alias("extra"),
            )
        )
        rows = _line(spark, d).select(
            views.scan_id(F.col("l_orderkey")).alias("scan_id"),
            F.lit("semgrep").alias("tool"),
            views.scan_root(F.col("l_orderkey")).alias("scan_root"),
            F.col("l_linenumber").alias("pos"),
            finding.alias("finding"),
        )
        tool = conform.REGISTRY["semgrep"]
        issues = conform.conform(src.read_split(rows, tool.dialect, mode), tool)
        return summary.scan_summary(views.scans(spark, d), issues)


_split_summary("strict")
_split_summary("quarantine")


@query(
    "g2_tool_breakdown",
    report_sql(f"""
SELECT a.scan_id, a.tool, {COUNTERS} FROM asked a LEFT JOIN iss USING (scan_id, tool) GROUP BY a.scan_id, a.tool"""),
)
def g2(spark, d):
    return summary.tool_breakdown(views.requested_tools(spark, d), conform.all_issues(views.reports(spark, d)))


@query("g3_issue_count", report_sql("SELECT count(*) AS n_issues FROM iss"))
def g3(spark, d):
    return summary.issue_count(conform.all_issues(views.reports(spark, d)))


@query(
    "g4_tools_used",
    report_sql("""
SELECT a.scan_id, a.tools_used, coalesce(f.tools, '') AS tools_with_findings
FROM (SELECT scan_id, string_agg(tool, ',' ORDER BY t) AS tools_used FROM asked GROUP BY scan_id) a
LEFT JOIN (SELECT scan_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM iss GROUP BY scan_id) f
USING (scan_id)"""),
)
def g4(spark, d):
    used = summary.tools_used(views.requested_tools(spark, d), conform.all_issues(views.reports(spark, d)))
    return used.select(
        "scan_id", *[F.array_join(c, ",").alias(c) for c in ("tools_used", "tools_with_findings")]
    )


# --- error rules -------------------------------------------------------------------------------

_STATUS = "scan_id, tool, status, reason, n_unusable, n_findings"


def _status(spark, d, mode="strict"):
    return conform.report_status(views.reports(spark, d), mode).drop("tool_rank")


@query(
    "e1_failure_isolation",
    report_sql("""
SELECT scan_id, string_agg(tool, ',' ORDER BY tool) FILTER (status IN ('error', 'terminated')) AS failed_tools,
  sum(n_findings)::BIGINT AS kept_findings FROM judged GROUP BY scan_id
HAVING count(*) FILTER (status IN ('error', 'terminated')) > 0"""),
)
def e1(spark, d):
    failed = F.col("status").isin("error", "terminated")
    return (
        _status(spark, d)
        .groupBy("scan_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("tool")))), ",").alias("failed_tools"),
            F.sum(F.col("n_findings").cast("bigint")).alias("kept_findings"),
        )
        .filter(F.col("failed_tools") != "")
    )


@query("e2_poison_strict", report_sql(f"SELECT {_STATUS} FROM judged WHERE n_unusable > 0"))
def e2(spark, d):
    return _status(spark, d).filter(F.col("n_unusable") > 0)


@query("e2_poison_quarantine", report_sql(f"SELECT {_STATUS} FROM judged WHERE n_unusable > 0", "quarantine"))
def e2q(spark, d):
    return _status(spark, d, "quarantine").filter(F.col("n_unusable") > 0)


@query("e3_empty_reports", report_sql(f"SELECT {_STATUS} FROM judged WHERE status = 'empty' OR reason = 'blank'"))
def e3(spark, d):
    return _status(spark, d).filter((F.col("status") == "empty") | (F.col("reason") == "blank"))


@query(
    "e4_bad_json",
    report_sql(f"SELECT {_STATUS} FROM judged WHERE reason IN ('bad_json', 'bad_type', 'null_document', 'no_results')"),
)
def e4(spark, d):
    return _status(spark, d).filter(F.col("reason").isin("bad_json", "bad_type", "null_document", "no_results"))


def _failures(spark, d, stage):
    issues = conform.all_issues(views.reports(spark, d))
    scans = views.scans(spark, d).filter(F.col("branch") != "develop") if stage == "insert" else views.scans(spark, d)
    return conform.scan_failures(issues, scans).filter(F.col("failed_at") == stage)


@query(
    "e5_missing_path",
    report_sql("SELECT DISTINCT scan_id, 'path' AS failed_at FROM iss WHERE file_path IS NULL"),
)
def e5(spark, d):
    return _failures(spark, d, "path")


@query(
    "e6_insert_violation",
    report_sql("""
SELECT i.scan_id, 'insert' AS failed_at FROM iss i JOIN orders o ON i.scan_id = 'scan_' || o.o_orderkey
GROUP BY i.scan_id, o.o_orderkey
HAVING count(*) FILTER (file_path IS NULL) = 0
  AND (count(*) FILTER (title IS NULL OR description IS NULL) > 0 OR o.o_orderkey % 4 = 0)"""),
)
def e6(spark, d):
    return _failures(spark, d, "insert")


@query(
    "e8_missing_tool",
    report_sql("""
SELECT a.scan_id, a.tool, coalesce(j.status, 'missing') AS status, j.reason, coalesce(j.n_findings, 0) AS n_findings
FROM asked a LEFT JOIN judged j USING (scan_id, tool)"""),
)
def e8(spark, d):
    return conform.run_status(views.requested_tools(spark, d), _status(spark, d))


@query(
    "e9_exit_code",
    report_sql("""
SELECT tool, status, reason, count(*) AS n_reports, sum(n_findings)::BIGINT AS n_findings
FROM judged WHERE failed GROUP BY tool, status, reason"""),
)
def e9(spark, d):
    failed = {tool: r.filter(F.col("exit_code") != 0) for tool, r in views.reports(spark, d).items()}
    return (
        conform.report_status(failed)
        .groupBy("tool", "status", "reason")
        .agg(F.count("*").alias("n_reports"), F.sum(F.col("n_findings").cast("bigint")).alias("n_findings"))
    )


@query("e10_terminated", report_sql(f"SELECT {_STATUS} FROM judged WHERE status = 'terminated'"))
def e10(spark, d):
    return _status(spark, d).filter(F.col("status") == "terminated")
