"""SQL for the report fixture: every expected value comes from ``orders``, never through JSON."""

from scanloom import constants as K

_ADVICE = {word: text for word, text in K.RULE_ADVICE}


def report_sql(body: str, mode: str = "strict") -> str:
    """``body`` over rep (reports), judged (with status), fnd (findings) and iss (issues)."""
    void = "n_bad > 0" if mode == "strict" else "false"
    usable = "true" if mode == "strict" else "k % 97 <> 0"
    return f"""
WITH tools(t, tool) AS (VALUES (0, 'semgrep'), (1, 'opengrep'), (2, 'gitleaks'), (3, 'checkov'), (4, 'trivy')),
rep AS MATERIALIZED (
  SELECT o_orderkey, o_custkey, t, tool, 'scan_' || o_orderkey AS scan_id,
         '/tmp/scan/scan_' || o_orderkey AS root,
         (o_orderkey + 2 * t) % 4 AS n, o_custkey % 6 AS e,
         o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS killed,
         o_orderpriority = '5-LOW' AS failed
  FROM orders CROSS JOIN tools
  WHERE NOT (tool IN ('opengrep', 'trivy') AND o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O')),
fnd AS MATERIALIZED (
  SELECT *, o_custkey + 7 * i + t AS k
  FROM (SELECT *, unnest(range(n))::INT AS i FROM rep)),
bad AS (SELECT scan_id, t, count(*) AS n_bad FROM fnd WHERE k % 97 = 0 GROUP BY scan_id, t),
reasoned AS MATERIALIZED (
  SELECT rep.*, coalesce(n_bad, 0) AS n_bad,
    CASE WHEN killed THEN 'signal'
         WHEN failed AND t IN (0, 1, 4) THEN 'exit_code'
         WHEN n = 0 AND e < 2 THEN 'blank'
         WHEN n = 0 AND e = 2 THEN CASE WHEN t = 3 THEN 'bad_finding' ELSE 'null_document' END
         WHEN n = 0 AND e = 3 AND t = 2 THEN 'bad_type'
         WHEN n = 0 AND e = 4 THEN 'bad_json'
         WHEN n = 0 AND e = 5 AND t IN (0, 1, 4) THEN 'no_results'
         WHEN {void} THEN 'bad_finding' END AS reason
  FROM rep LEFT JOIN bad USING (scan_id, t)),
judged AS MATERIALIZED (
  SELECT *,
    CASE WHEN reason IN ('signal', 'exit_code', 'blank', 'null_document', 'bad_type', 'bad_json', 'no_results')
           OR (reason = 'bad_finding' AND n = 0) THEN 0 ELSE n_bad::INT END AS n_unusable,
    CASE WHEN reason IS NOT NULL THEN 0 WHEN '{mode}' = 'strict' THEN n::INT ELSE (n - n_bad)::INT END AS n_findings,
    CASE WHEN reason = 'signal' THEN 'terminated'
         WHEN reason IN ('exit_code', 'bad_type', 'null_document', 'bad_finding') THEN 'error'
         WHEN reason = 'blank' AND t < 2 THEN 'error'
         WHEN reason = 'bad_json' AND t <> 4 THEN 'error'
         WHEN reason IS NOT NULL OR n = 0 OR ('{mode}' = 'quarantine' AND n = n_bad) THEN 'empty'
         ELSE 'ok' END AS status
  FROM reasoned),
usable AS (
  SELECT f.*, 'src/' || (k % 50) || '.txt' AS base, (1 + k % 200)::INT AS line
  FROM fnd f JOIN judged j USING (scan_id, t) WHERE j.reason IS NULL AND {usable}),
iss AS (
  SELECT scan_id, tool, t AS tool_rank, (row_number() OVER (PARTITION BY scan_id, t ORDER BY i) - 1)::INT AS pos, k, i,
    CASE WHEN t < 2 THEN ['critical', 'critical', 'high', 'medium', 'low'][k % 5 + 1]
         WHEN t = 2 THEN 'critical'
         WHEN t = 3 THEN ['critical', 'high', 'medium', 'low', 'medium'][k % 5 + 1]
         ELSE ['critical', 'high', 'medium', 'low', 'info'][k % 5 + 1] END AS severity,
    CASE WHEN t < 2 THEN CASE WHEN k % 401 <> 0 THEN 'rule.' || (k % 13) END
         WHEN t = 2 THEN '{K.SECRET_TITLE}' || CASE WHEN k % 11 = 0 THEN 'undefined' ELSE 'rule-' || (k % 7) END
         WHEN t = 3 THEN CASE WHEN k % 401 <> 0 THEN 'check ' || (k % 17) END
         ELSE 'CVE-' || k || ': pkg' || (k % 29) END AS title,
    CASE WHEN t < 2 THEN 'finding ' || k
         WHEN t = 2 THEN CASE WHEN k % 401 <> 0 THEN 'secret ' || k END
         WHEN t = 3 THEN '{K.POLICY_DESCRIPTION}' || CASE WHEN k % 13 = 0 THEN 'undefined' ELSE 'res.' || k END
         WHEN k % 401 = 0 THEN NULL
         WHEN k % 4 = 0 THEN 'desc ' || k ELSE 'vuln ' || k END AS description,
    CASE WHEN k % 389 = 0 THEN NULL WHEN k % 4 = 2 THEN 'nested/' || base ELSE base END AS file_path,
    CASE WHEN t = 4 THEN 1 ELSE line END AS line_start,
    CASE WHEN t = 4 THEN NULL ELSE line + i END AS line_end,
    CASE WHEN t = 2 THEN
      CASE WHEN length('k' || k || 'x' || o_orderkey) <= 8 THEN '***'
           ELSE substr('k' || k || 'x' || o_orderkey, 1, 4) || '***' || right('k' || k || 'x' || o_orderkey, 4) END
      END AS code,
    CASE WHEN t < 2 THEN CASE k % 4 WHEN 0 THEN '{_ADVICE["injection"]}' WHEN 1 THEN '{_ADVICE["xss"]}'
                           WHEN 2 THEN '{_ADVICE["crypto"]}' ELSE '{K.RULE_ADVICE_DEFAULT}' END
         WHEN t = 2 THEN '{K.SECRET_ADVICE}'
         WHEN t = 3 THEN CASE WHEN k % 3 = 0 THEN 'https://guide/' || k ELSE '{K.POLICY_ADVICE}' END
         WHEN k % 3 = 0 THEN 'Update pkg' || (k % 29) || ' from 1.' || (k % 10) || ' to 2.' || (k % 10)
         ELSE 'No fix available yet for pkg' || (k % 29) || '. Monitor for updates.' END AS recommendation,
    CASE WHEN t = 0 AND k % 4 <> 3 AND k % 3 = 0 THEN 'CWE-79,CWE-89'
         WHEN t = 1 AND k % 4 <> 3 THEN '' END AS cwe,
    CASE WHEN t < 2 THEN CASE WHEN k % 4 <> 3 AND k % 2 = 0 THEN 'A03:2021' END
         WHEN t = 2 THEN '{K.SECRET_OWASP}' WHEN t = 3 THEN '{K.POLICY_OWASP}'
         ELSE '{K.PACKAGE_OWASP}' END AS owasp
  FROM usable),
asked AS (
  SELECT 'scan_' || o_orderkey AS scan_id, tool, t FROM orders CROSS JOIN tools
  WHERE NOT (o_orderpriority = '2-HIGH' AND tool IN ('checkov', 'semgrep')))
{body}
"""


ISSUE_COLUMNS = (
    "scan_id, pos, tool, severity, title, description, file_path, line_start, line_end, code, recommendation, cwe, owasp"
)
COUNTERS = """count(*) FILTER (severity = 'critical') AS critical_count,
  count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count,
  count(*) FILTER (severity = 'low') AS low_count, count(*) FILTER (severity = 'info') AS info_count,
  count(severity) AS total_issues"""
