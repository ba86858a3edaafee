"""Scanner queries: whole texts, configurations and packages to issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.operators import advisories, detect, ordinals, policies, secrets, summary
from scanloom.plans.registry import query
from scanloom.plans.report_sql import COUNTERS
from scanloom.sources import files as fs
from scanloom.sources import views
from scanloom.sources.tables import table

_ADVICE = dict(K.RULE_ADVICE)


def _documents(spark, d):
    """One scan per document source."""
    root = F.concat(F.lit("/scan/"), F.col("source"))
    return table(spark, d, "documents").select(
        F.concat(F.lit("scan_"), F.col("source")).alias("scan_id"),
        root.alias("scan_root"),
        F.concat(root, F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"),
        "text",
    )


def _pages(spark, d):
    root = F.lit("/scan/web")
    return table(spark, d, "pages").select(
        F.lit("scan_web").alias("scan_id"),
        root.alias("scan_root"),
        F.concat(root, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit("html").alias("language"),
        F.col("html").alias("text"),
    )


_QUOTED = detect.SECRET_RULES[0].pattern
_HEX = detect.SECRET_RULES[1].pattern

_SECRETS = f"""
WITH doc AS (SELECT 'scan_' || source AS scan_id, lang || '/' || doc_id || '.txt' AS file_path, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT scan_id, file_path, ls[i] AS line, i::INT AS line_start FROM doc, unnest(range(1, len(ls) + 1)) AS r(i)),
hit AS (
  SELECT scan_id, file_path, line_start, 'quoted-credential' AS rule, unnest(regexp_extract_all(line, '{_QUOTED}', 2)) AS secret FROM line
  UNION ALL
  SELECT scan_id, file_path, line_start, 'hex-token', unnest(regexp_extract_all(line, '{_HEX}', 1)) FROM line)
"""


@query(
    "r1_secret_scan",
    _SECRETS + f"""
SELECT scan_id, file_path, line_start, '{K.SECRET_TITLE}' || rule AS title, 'critical' AS severity,
  CASE WHEN length(secret) <= 8 THEN '***' ELSE secret[:4] || '***' || right(secret, 4) END AS code FROM hit""",
)
def r1(spark, d):
    issues = detect.as_issues(detect.secret_findings(_documents(spark, d)), "gitleaks")
    return issues.select("scan_id", "file_path", "line_start", "title", "severity", "code")


@query(
    "r1_secret_summary",
    _SECRETS + f"""
, iss AS (SELECT scan_id, 'critical' AS severity FROM hit)
SELECT s.scan_id, {COUNTERS} FROM (SELECT DISTINCT scan_id FROM doc) s LEFT JOIN iss USING (scan_id) GROUP BY s.scan_id""",
)
def r1_summary(spark, d):
    files = _documents(spark, d)
    issues = detect.as_issues(detect.secret_findings(files), "gitleaks")
    return summary.scan_summary(files.select("scan_id").distinct(), issues)


def _keyed_sql() -> str:
    """Every pattern on every text. The text between matches gives their places."""
    text = lambda value: "'" + value.replace("'", "''") + "'"
    parts = []
    for r in secrets.KEYED_RULES:
        p = text(r.pattern)
        allowed = " OR ".join(f"regexp_matches(secret, {text(a)})" for a in r.allow) or "FALSE"
        parts.append(f"""
  SELECT scan_id, file_path, {text(r.id)} AS rule, line_start, line_start + len(string_split(hit, chr(10))) - 1 AS line_end, secret FROM (
    SELECT scan_id, file_path, hits[i] AS hit, regexp_extract_all(text, {p}, {r.group})[i] AS secret,
           len(string_split(array_to_string(gaps[1:i], '') || array_to_string(hits[1:i - 1], ''), chr(10))) AS line_start
    FROM (SELECT *, regexp_extract_all(text, {p}, 0) AS hits, string_split_regex(text, {p}) AS gaps FROM doc), unnest(range(1, len(hits) + 1)) AS r(i))
  WHERE entropy(secret) >= {r.entropy} AND NOT ({allowed})""")
    return f"""
WITH doc AS (
  SELECT 'scan_' || source AS scan_id, lang || '/' || doc_id || '.txt' AS file_path, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'scan_web', page_id || '.html', html FROM pages WHERE html IS NOT NULL),
hit AS ({" UNION ALL ".join(parts)})
SELECT scan_id, file_path, line_start::INT AS line_start, line_end::INT AS line_end, '{K.SECRET_TITLE}' || rule AS title,
  CASE WHEN length(secret) <= 8 THEN '***' ELSE secret[:4] || '***' || right(secret, 4) END AS code FROM hit"""


_ENTROPY = "(SELECT COALESCE(-SUM(n / t * log2(n / t)), 0) FROM (SELECT COUNT(*)::DOUBLE AS n, length(secret)::DOUBLE AS t FROM (SELECT unnest(string_split(secret, '')) AS c) GROUP BY c))"


@query("r1_keyed_secrets", _keyed_sql().replace("entropy(secret)", _ENTROPY))
def r1_keyed(spark, d):
    files = _documents(spark, d).unionByName(_pages(spark, d)).drop("language")
    issues = detect.as_issues(secrets.keyed_findings(files), "gitleaks")
    return issues.select("scan_id", "file_path", "line_start", "line_end", "title", "code")


def _pattern_sql() -> str:
    severity = {"WARNING": "high", "INFO": "medium", "ERROR": "critical"}
    parts = []
    for r in detect.PATTERN_RULES:
        where = f"WHERE language = '{r.language}'" if r.language else ""
        advice = _ADVICE.get(r.category, K.RULE_ADVICE_DEFAULT)
        parts.append(
            f"SELECT scan_id, file_path, line_start, '{r.id}' AS title, '{severity[r.severity]}' AS severity, "
            f"'{','.join(r.cwe)}' AS cwe, '{advice}' AS recommendation, "
            f"unnest(regexp_extract_all(line, '{r.pattern}', 0)) AS hit FROM line {where}"
        )
    return f"""
WITH file AS (
  SELECT 'scan_' || source AS scan_id, lang || '/' || doc_id || '.txt' AS file_path, lang AS language, string_split(text, chr(10)) AS ls FROM documents
  UNION ALL SELECT 'scan_web', page_id || '.html', 'html', string_split(html, chr(10)) FROM pages),
line AS (SELECT scan_id, file_path, language, ls[i] AS line, i::INT AS line_start FROM file, unnest(range(1, len(ls) + 1)) AS r(i)),
hit AS ({" UNION ALL ".join(parts)})
SELECT scan_id, file_path, line_start, title, severity, cwe, recommendation FROM hit"""


@query("r2_pattern_scan", _pattern_sql())
def r2(spark, d):
    files = _documents(spark, d).unionByName(_pages(spark, d))
    issues = detect.as_issues(detect.pattern_findings(files), "semgrep")
    return issues.select(
        "scan_id", "file_path", "line_start", "title", "severity", F.array_join("cwe", ",").alias("cwe"), "recommendation"
    )


_DETECTED = f"""
SELECT scan_id, tool_rank, file_path, line_start, title,
  row_number() OVER (PARTITION BY scan_id ORDER BY tool_rank, file_path, line_start, title) AS ordinal
FROM (SELECT scan_id, 2 AS tool_rank, file_path, line_start, title FROM ({_keyed_sql().replace("entropy(secret)", _ENTROPY)})
      UNION ALL SELECT scan_id, 0, file_path, line_start, title FROM ({_pattern_sql()}))"""


@query("o1_detected_ordinal", _DETECTED)
def o1_detected(spark, d):
    """Numbers of issues found by the scanners over tables: several on a line, many files a scan."""
    files = _documents(spark, d).unionByName(_pages(spark, d))
    found = detect.as_issues(secrets.keyed_findings(files.drop("language")), "gitleaks")
    found = found.unionByName(detect.as_issues(detect.pattern_findings(files), "semgrep"))
    numbered = ordinals.dense_ordinals(found, ["tool_rank", "file_path", "line_start", "title"])
    return numbered.select("scan_id", "tool_rank", "file_path", "line_start", "title", "ordinal")


_POLICIES = (
    detect.Policy("CFG_1", "k below fifty", "policy.HIGH", lambda: F.col("k") < 50, "https://guide/k"),
    detect.Policy("CFG_2", "k not round", "policy.ALLOW", lambda: F.col("k") % 10 != 0),
    detect.Policy("CFG_3", "purchases need k", "policy", lambda: (F.col("path") != "conf/purchase.json") | (F.col("k") > 5)),
)


@query(
    "r3_policy_check",
    f"""
WITH conf AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
failed AS (
  SELECT event_id, event_type, 'k below fifty' AS title, 'high' AS severity, 'https://guide/k' AS recommendation FROM conf WHERE NOT k < 50
  UNION ALL SELECT event_id, event_type, 'k not round', 'low', '{K.POLICY_ADVICE}' FROM conf WHERE k % 10 = 0
  UNION ALL SELECT event_id, event_type, 'purchases need k', 'medium', '{K.POLICY_ADVICE}' FROM conf WHERE event_type = 'purchase' AND k <= 5)
SELECT 'scan_' || event_type AS scan_id, 'conf/' || event_type || '.json' AS file_path, title, severity, recommendation,
  '{K.POLICY_DESCRIPTION}event.' || event_id AS description FROM failed""",
)
def r3(spark, d):
    settings = F.from_json("props", "k INT")
    configs = table(spark, d, "events").select(
        F.concat(F.lit("scan_"), F.col("event_type")).alias("scan_id"),
        F.lit("/scan").alias("scan_root"),
        F.concat(F.lit("conf/"), F.col("event_type"), F.lit(".json")).alias("path"),
        F.concat(F.lit("event."), F.col("event_id").cast("string")).alias("resource"),
        settings["k"].alias("k"),
    )
    issues = detect.as_issues(detect.policy_findings(configs, _POLICIES), "checkov")
    return issues.select("scan_id", "file_path", "title", "severity", "recommendation", "description")


def _packages(spark, d):
    key = F.col("p_partkey")
    folder = F.when(F.col("p_type") == "ECONOMY", "node_modules/").otherwise("app/")
    return table(spark, d, "part").select(
        F.concat(F.lit("scan_"), F.col("p_type")).alias("scan_id"),
        F.lit("/scan").alias("scan_root"),
        F.concat(folder, key.cast("string"), F.lit(".lock")).alias("path"),
        F.col("p_brand").alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit("."), (key % 12).cast("string")).alias("version"),
    )


def _advisories(spark, d):
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.concat(F.lit("Brand#"), (key + 1).cast("string")).alias("name"),
        F.concat(F.lit("ADV-"), key.cast("string")).alias("id"),
        views.pick(views.PACKAGE_LEVELS, key % 5).alias("severity"),
        F.concat(F.lit("flaw "), key.cast("string")).alias("title"),
        F.concat((key % 10).cast("string"), F.lit(".3")).alias("introduced"),
        F.when(key % 4 != 0, F.concat((20 + key).cast("string"), F.lit(".5"))).alias("fixed"),
    )


@query(
    "r4_advisory_match",
    """
WITH adv AS (SELECT n_nationkey AS k, 'Brand#' || (n_nationkey + 1) AS name FROM nation),
pkg AS (SELECT *, p_size || '.' || (p_partkey % 12) AS version FROM part WHERE p_type <> 'ECONOMY')
SELECT 'scan_' || p_type AS scan_id, 'app/' || p_partkey || '.lock' AS file_path, 'ADV-' || k || ': ' || name AS title,
  ['critical', 'high', 'medium', 'low', 'info'][k % 5 + 1] AS severity, 'flaw ' || k AS description,
  CASE WHEN k % 4 <> 0 THEN 'Update ' || name || ' from ' || version || ' to ' || (20 + k) || '.5'
    ELSE 'No fix available yet for ' || name || '. Monitor for updates.' END AS recommendation
FROM pkg JOIN adv ON p_brand = name
WHERE (p_size > k % 10 OR (p_size = k % 10 AND p_partkey % 12 >= 3))
  AND (k % 4 = 0 OR p_size < 20 + k OR (p_size = 20 + k AND p_partkey % 12 < 5))""",
)
def r4(spark, d):
    kept = _packages(spark, d).filter(fs.outside(F.col("path"), views.SKIP_DIRS))
    issues = detect.as_issues(detect.advisory_findings(kept, _advisories(spark, d)), "trivy")
    return issues.select("scan_id", "file_path", "title", "severity", "description", "recommendation")


def _lock_files(spark, d):
    """Installed packages of two ecosystems: pre-releases, dates as numbers; epochs, revisions, versions before the first."""
    k, size, minor = F.col("p_partkey"), F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")
    nothing = F.lit("")
    major = F.when(k % 7 == 0, (F.lit(20240101120000) + F.col("p_size")).cast("string")).otherwise(size)
    semver = F.concat(major, F.lit("."), minor, F.when(k % 5 == 0, F.concat(F.lit("-rc."), (k % 13).cast("string"))).otherwise(nothing))
    debian = F.concat(
        F.when(k % 3 > 0, F.concat((k % 3).cast("string"), F.lit(":"))).otherwise(nothing),
        size, F.lit("."), minor,
        F.when(k % 5 == 1, F.concat(F.lit("~rc"), (k % 13).cast("string"))).otherwise(nothing),
        F.when(k % 4 > 0, F.concat(F.lit("-"), (k % 4).cast("string"))).otherwise(nothing),
        F.when(k % 8 == 3, F.concat(F.lit("ubuntu"), (k % 11).cast("string"))).otherwise(nothing),
    )
    is_debian = k % 2 == 1
    return table(spark, d, "part").select(
        F.concat(F.lit("scan_"), F.col("p_type")).alias("scan_id"),
        F.lit("/scan").alias("scan_root"),
        F.concat(F.lit("app/"), k.cast("string"), F.lit(".lock")).alias("path"),
        F.when(is_debian, advisories.DEBIAN).otherwise(advisories.SEMVER).alias("ecosystem"),
        F.col("p_brand").alias("name"),
        F.when(is_debian, debian).otherwise(semver).alias("version"),
    )


def _ranged_advisories(spark, d):
    k = F.col("n_nationkey")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    span = lambda low, high: F.struct(low.alias("introduced"), high.alias("fixed"))
    semver = F.array(
        span(text(k % 10, ".3-rc.2"), text(k % 10 + 8, ".5")),
        span(text(k % 10 + 20, ".0-rc.", k % 13), F.when(k % 3 > 0, text(F.lit(20240101120000) + k, ".6"))),
    )
    debian = F.array(
        span(F.when(k % 6 > 0, text(k % 10, ".3~rc4")), text("1:", k % 10, ".6-2")),
        span(text("1:", k % 10, ".2"), text("1:", k % 10 + 9, ".1-3ubuntu5")),
        span(text("2:", k + 5, ".1~rc10"), F.when(k % 4 > 0, text("2:", k + 9, ".1-3ubuntu3"))),
    )
    rows = table(spark, d, "nation").select(
        k, F.inline(F.array(
            F.struct(F.lit(advisories.SEMVER).alias("ecosystem"), F.lit("ADV-").alias("kind"), semver.alias("ranges")),
            F.struct(F.lit(advisories.DEBIAN).alias("ecosystem"), F.lit("DSA-").alias("kind"), debian.alias("ranges")),
        ))
    )
    return rows.select(
        "ecosystem", text("Brand#", k + 1).alias("name"), F.concat("kind", k.cast("string")).alias("id"),
        views.pick(views.PACKAGE_LEVELS, k % 5).alias("severity"), text("flaw ", k).alias("title"), "ranges",
    )


@query(
    "r4_ranged_advisories",
    """
WITH pkg AS (
  SELECT p_type, p_partkey AS k, p_brand AS name, p_partkey % 2 = 1 AS deb, CASE WHEN k % 2 = 1
    THEN [k % 3, p_size, k % 12, CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END, CASE WHEN k % 5 = 1 THEN k % 13 ELSE 0 END, k % 4, (k % 8 = 3)::BIGINT, CASE WHEN k % 8 = 3 THEN k % 11 ELSE 0 END]
    ELSE [CASE WHEN k % 7 = 0 THEN 20240101120000 + p_size ELSE p_size END, k % 12, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN k % 5 = 0 THEN k % 13 ELSE 0 END] END AS v
  FROM part),
span AS (
  SELECT n AS k, false AS deb, [n % 10, 3, 0, 2] AS low, [n % 10 + 8, 5, 1, 0] AS high, (n % 10 + 8) || '.5' AS fixed FROM (SELECT n_nationkey::BIGINT AS n FROM nation)
  UNION ALL SELECT n, false, [n % 10 + 20, 0, 0, n % 13], CASE WHEN n % 3 > 0 THEN [20240101120000 + n, 6, 1, 0] END,
    CASE WHEN n % 3 > 0 THEN (20240101120000 + n) || '.6' END FROM (SELECT n_nationkey::BIGINT AS n FROM nation)
  UNION ALL SELECT n, true, CASE WHEN n % 6 > 0 THEN [0, n % 10, 3, 0, 4, 0, 0, 0] END, [1, n % 10, 6, 1, 0, 2, 0, 0], '1:' || (n % 10) || '.6-2' FROM (SELECT n_nationkey::BIGINT AS n FROM nation)
  UNION ALL SELECT n, true, [1, n % 10, 2, 1, 0, 0, 0, 0], [1, n % 10 + 9, 1, 1, 0, 3, 1, 5], '1:' || (n % 10 + 9) || '.1-3ubuntu5' FROM (SELECT n_nationkey::BIGINT AS n FROM nation)
  UNION ALL SELECT n, true, [2, n + 5, 1, 0, 10, 0, 0, 0], CASE WHEN n % 4 > 0 THEN [2, n + 9, 1, 1, 0, 3, 1, 3] END,
    CASE WHEN n % 4 > 0 THEN '2:' || (n + 9) || '.1-3ubuntu3' END FROM (SELECT n_nationkey::BIGINT AS n FROM nation)),
hit AS (
  SELECT p_type, pkg.k AS part, span.k AS n, pkg.deb, arg_min(fixed, high) FILTER (high IS NOT NULL) AS fixed
  FROM pkg JOIN span ON name = 'Brand#' || (span.k + 1) AND pkg.deb = span.deb AND (low IS NULL OR low <= v) AND (high IS NULL OR v < high)
  GROUP BY p_type, pkg.k, span.k, pkg.deb)
SELECT 'scan_' || p_type AS scan_id, 'app/' || part || '.lock' AS file_path, CASE WHEN deb THEN 'DSA-' ELSE 'ADV-' END || n || ': Brand#' || (n + 1) AS title,
  ['critical', 'high', 'medium', 'low', 'info'][n % 5 + 1] AS severity, fixed FROM hit""",
)
def r4_ranged(spark, d):
    """Several ranges an advisory, overlapping too, in the order of each ecosystem; an advisory's nearest fix."""
    found = advisories.ranged_findings(_lock_files(spark, d), _ranged_advisories(spark, d))
    issues = detect.as_issues(found, "trivy")
    return issues.select("scan_id", "file_path", "title", "severity", F.regexp_extract("recommendation", r" to (\S+)$", 1).alias("fixed")).replace("", None, "fixed")


def _nested_configs(spark, d):
    """A document an event: a bucket, for some a network, and a user of the bucket of another event of the kind."""
    key, user = F.col("event_id"), F.col("user_id")
    k = F.from_json("props", "k INT")["k"]
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bucket = F.struct(
        F.struct((k % 3 != 0).alias("enabled"), F.when(k % 2 == 0, "aes256").otherwise("des").alias("algorithm"), (k % 7).alias("rotation")).alias("encryption"),
        F.struct(k.alias("keep"), (k % 5 == 0).alias("locked")).alias("versions"),
        F.struct(F.when(k % 4 != 0, text("team", k)).alias("owner"), F.when(k % 6 == 0, "x").alias("temporary")).alias("tags"),
        F.when(k % 8 == 0, F.array(F.lit("private"), F.lit("public-read"))).otherwise(F.array(F.lit("private"))).alias("acl"),
        F.struct(F.array(F.struct(F.when(k % 9 == 0, "0.0.0.0/0").otherwise("10.0.0.0/8").alias("from"))).alias("allow")).alias("access"),
        F.when(k % 10 != 9, text("network.n", user % 40)).alias("network"),
    )
    network = F.struct(
        F.struct((k > 30).alias("enabled"), (k * 2).alias("days")).alias("logging"),
        F.when(k % 3 == 0, F.array(F.lit("22"), F.lit("443"))).otherwise(F.array(F.lit("443"))).alias("ports"),
        F.when(k % 5 != 1, text("zone-", k % 4)).alias("zone"),
    )
    role = F.struct(text("bucket.b", key - key % 3).alias("bucket"), F.array(F.lit("read"), F.when(k % 4 == 0, "*").otherwise("list")).alias("actions"))
    entry = lambda kind, name, settings: F.to_json(F.struct(F.lit(kind).alias("type"), name.alias("name"), settings.alias("settings")))
    listed = F.array_compact(
        F.array(
            entry("bucket", text("b", key), bucket),
            F.when(key % 4 == 0, entry("network", text("n", F.floor(key / 4) % 40), network)),
            F.when(key % 2 == 0, entry("role", text("r", key), role)),
        )
    )
    return table(spark, d, "events").select(
        F.concat(F.lit("scan_"), F.col("event_type")).alias("scan_id"),
        F.lit("/scan").alias("scan_root"),
        text("/scan/conf/", key, ".json").alias("path"),
        F.concat(F.lit('{"version": 1, "resources": ['), F.array_join(listed, ", "), F.lit("]}")).alias("text"),
    )


# Each rule with the condition under which it fails, by the columns the documents are made of.
_NESTED = [
    (policies.PathRule("B1", "encrypted", "policy.CRITICAL", "bucket", "$.encryption.enabled", "equals", "true"), "k % 3 = 0"),
    (policies.PathRule("B2", "strong cipher", "policy.HIGH", "bucket", "$.encryption.algorithm", "one_of", ("aes256", "aes128")), "k % 2 = 1"),
    (policies.PathRule("B3", "weak cipher", "policy.HIGH", "bucket", "$.encryption.algorithm", "differs", "des"), "k % 2 = 1"),
    (policies.PathRule("B4", "keys rotate", "policy.MEDIUM", "bucket", "$.encryption.rotation", "at_least", 2), "k % 7 < 2"),
    (policies.PathRule("B5", "few versions", "policy.ALLOW", "bucket", "$.versions.keep", "at_most", 60), "k > 60"),
    (policies.PathRule("B6", "locked", "policy.MEDIUM", "bucket", "$.versions.locked", "equals", "true"), "k % 5 <> 0"),
    (policies.PathRule("B7", "has an owner", "policy.ALLOW", "bucket", "$.tags.owner", "present"), "k % 4 = 0"),
    (policies.PathRule("B8", "owner is a team", "policy", "bucket", "$.tags.owner", "matches", "^team[0-9]$"), "k % 4 = 0 OR k > 9"),
    (policies.PathRule("B9", "not temporary", "policy.ALLOW", "bucket", "$.tags.temporary", "absent"), "k % 6 = 0"),
    (policies.PathRule("B10", "not public", "policy.CRITICAL", "bucket", "$.acl", "none_of", ("public-read", "public-write")), "k % 8 = 0"),
    (policies.PathRule("B11", "private listed", "policy", "bucket", "$.acl", "all_of", ("private",)), "FALSE"),
    (policies.PathRule("B12", "closed to the world", "policy.HIGH", "bucket", "$.access.allow[0].from", "differs", "0.0.0.0/0"), "k % 9 = 0"),
    (policies.PathRule("N1", "network logs", "policy.HIGH", "network", "$.logging.enabled", "equals", "true"), "NOT k > 30"),
    (policies.PathRule("N2", "logs are kept", "policy.MEDIUM", "network", "$.logging.days", "at_least", 30.5), "k * 2 < 30.5"),
    (policies.PathRule("N3", "no shell port", "policy.HIGH", "network", "$.ports", "none_of", ("22",)), "k % 3 = 0"),
    (policies.PathRule("N4", "zone named", "policy.ALLOW", "network", "$.zone", "matches", "^zone-[0-2]$"), "k % 5 = 1 OR k % 4 = 3"),
    (policies.PathRule("R1", "no wildcard", "policy.CRITICAL", "role", "$.actions", "none_of", ("*",)), "k % 4 = 0"),
    (policies.TargetRule("X1", "in a known network", "policy.MEDIUM", "bucket", "$.network", policies.PathRule("", "", "", "network", "$.logging", "present")), ""),
    (policies.TargetRule("X2", "network logs", "policy.HIGH", "bucket", "$.network", policies.PathRule("", "", "", "network", "$.logging.enabled", "equals", "true")), ""),
    (policies.NeededRule("X3", "a role uses it", "policy.ALLOW", "bucket", "role", "$.bucket"), ""),
]
_OF_TYPE = {"bucket": ("TRUE", "'b' || event_id"), "network": ("event_id % 4 = 0", "'n' || (event_id // 4 % 40)"), "role": ("event_id % 2 = 0", "'r' || event_id")}


def _nested_sql() -> str:
    parts = []
    for rule, fails in _NESTED:
        if fails:
            exists, name = _OF_TYPE[rule.type]
            parts.append(f"SELECT event_type, event_id, '{rule.name}' AS title, '{rule.type}.' || {name} AS resource FROM e WHERE {exists} AND ({fails})")
    return f"""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
net AS (SELECT event_type, event_id // 4 % 40 AS n, bool_or(k > 30) AS logs FROM e WHERE event_id % 4 = 0 GROUP BY ALL),
used AS (SELECT DISTINCT event_type, event_id - event_id % 3 AS bucket FROM e WHERE event_id % 2 = 0),
placed AS (SELECT e.event_type, e.event_id, net.n IS NOT NULL AS known, net.logs FROM e LEFT JOIN net ON net.event_type = e.event_type AND net.n = e.user_id % 40 AND k % 10 <> 9),
failed AS (
  {" UNION ALL ".join(parts)}
  UNION ALL SELECT event_type, event_id, 'in a known network', 'bucket.b' || event_id FROM placed WHERE NOT known
  UNION ALL SELECT event_type, event_id, 'network logs', 'bucket.b' || event_id FROM placed WHERE NOT coalesce(logs, false)
  UNION ALL SELECT e.event_type, e.event_id, 'a role uses it', 'bucket.b' || e.event_id FROM e ANTI JOIN used u ON u.event_type = e.event_type AND u.bucket = e.event_id)
SELECT 'scan_' || event_type AS scan_id, 'conf/' || event_id || '.json' AS file_path, title, '{K.POLICY_DESCRIPTION}' || resource AS description FROM failed"""


@query("r3_nested_policies", _nested_sql())
def r3_nested(spark, d):
    """Twenty rules on nested settings, three of them across resources of a scan."""
    found = policies.nested_findings(_nested_configs(spark, d), tuple(rule for rule, _ in _NESTED))
    return detect.as_issues(found, "checkov").select("scan_id", "file_path", "title", "description")
