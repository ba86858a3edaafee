"""Application-shaped views over the star-schema test tables.

Nothing here is needed by a deployment that has real tables; the operators only see DataFrames.
Every view is a narrow projection of a whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.constants import TOOLS
from scanloom.sources.tables import table

NOW_TEXT = "2024-01-01 00:10:00"

# What a scanner may print when it found nothing, by customer.
EMPTY_TEXTS = ["", " \n\t", "null", "{}", "nope", "[]"]

RULE_LEVELS = ["ERROR", "critical", "Warning", "INFO", "EXPERIMENT"]
POLICY_CLASSES = ["policy.CRITICAL.x", "policy.HIGH.x", "policy.MEDIUM.x", "policy.ALLOW.x", "policy.other"]
PACKAGE_LEVELS = ["CRITICAL", "high", "Medium", "LOW", "UNKNOWN"]
CATEGORIES = ["sql-injection", "xss-reflected", "crypto-weak"]


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW_TEXT))


def pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def scan_id(key: Column) -> Column:
    return _text("scan_", key)


def scan_root(key: Column) -> Column:
    return _text("/tmp/scan/scan_", key)


def finding_path(k: Column, root: Column) -> Column:
    """Below the root, with the root twice, or relative already; missing for a few."""
    base = F.concat(F.lit("src/"), (k % 50).cast("string"), F.lit(".txt"))
    return F.when(k % 389 != 0, F.when(k % 4 < 2, F.concat(root, F.lit("/"), base))
                  .when(k % 4 == 2, F.concat(root, F.lit("/nested"), root, F.lit("/"), base)).otherwise(base))


def _usable(k: Column, value: Column) -> Column:
    """The field without which a finding voids its report."""
    return F.when(k % 97 != 0, value).otherwise("")


def _named(k: Column, value: Column) -> Column:
    """A field that only the issue table insists on."""
    return F.when(k % 401 != 0, value).otherwise("")


# The texts of reports are put together from a few pieces: structs made in a lambda and written as JSON are interpreted value
# by value. No value in them needs an escape.


def _remainder(k: int, size: int) -> int:
    """The remainder with the sign of ``k``, as SQL has it."""
    return k % size if k >= 0 else -(-k % size)


def _by(k: Column, size: int, text: Callable[[int], str]) -> Column:
    """``text`` of the remainder of ``k``, looked up in a constant list; it is split from one literal, as many take long to send."""
    texts = F.split(F.lit("|".join(text(r) for r in range(1 - size, size))), "[|]")
    return F.get(texts, k % size + F.lit(size - 1))


def _of(words: list[str], r: int, text: str) -> str:
    """``text`` with the word at the place ``r``, nothing where there is none."""
    return text.format(words[r]) if 0 <= r < len(words) else ""


def _number(k: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), k.cast("string"), F.lit(after))


def _usable_by(k: Column, words: list[str], text: str) -> Column:
    """A word by the fifth, as ``_usable`` has it, in one look."""
    return _by(k, 5 * 97, lambda r: _of(words, _remainder(r, 5), text) if r % 97 else "")


def _path(k: Column, made: dict[str, Column], before: str, after: str) -> Column:
    """The text of ``finding_path`` as a member; nothing where it is missing."""
    place = F.when(made["fourth"] < 2, made["below"]).when(made["fourth"] == 2, made["twice"]).otherwise("src/")
    return F.when(k % 389 != 0, F.concat(F.lit(before), place, _by(k, 50, lambda r: f"{r}.txt{after}"))).otherwise("")


def _rule_finding(tool: str, i: int, k: Column, key: Column, made: dict[str, Column]) -> Column:
    def metadata(r: int) -> str:
        if _remainder(r, 4) == 3:
            return "}}"
        cwe = (['"cwe":["CWE-79","CWE-89"]'] if r % 3 == 0 else []) if tool == "semgrep" else ['"cwe":"CWE-20"']
        owasp = ['"owasp":["A03:2021"]'] if r % 2 == 0 else []
        category = [c for c in [_of(CATEGORIES, _remainder(r, 4), '"category":"{}"')] if c]
        return ',"metadata":{' + ",".join([*cwe, *owasp, *category]) + "}}}"

    def lines(r: int) -> str:
        return f'"start":{{"line":{1 + r},"col":1}},"end":{{"line":{1 + r + i},"col":9}},"extra":{{"message":"finding '

    return F.concat(
        F.lit("{"),
        _named(k, _by(k, 13, lambda r: f'"check_id":"rule.{r}",')),
        _path(k, made, '"path":"', '",'),
        _by(k, 200, lines),
        _number(k, "", '"'),
        _usable_by(k, RULE_LEVELS, ',"severity":"{}"'),
        _by(k, 12, metadata),
    )


def _secret_finding(i: int, k: Column, key: Column, made: dict[str, Column]) -> Column:
    return F.concat(
        F.lit("{"),
        _named(k, _number(k, '"Description":"secret ', '",')),
        _by(k, 200, lambda r: f'"StartLine":{1 + r},"EndLine":{1 + r + i}'),
        _path(k, made, ',"File":"', '"'),
        _usable(k, F.concat(_number(k, ',"Secret":"k', "x"), _number(key, "", '"'))),
        F.when(k % 11 != 0, _by(k, 7, lambda r: f',"RuleID":"rule-{r}"')).otherwise(""),
        F.lit("}"),
    )


def _policy_finding(i: int, k: Column, key: Column, made: dict[str, Column]) -> Column:
    return F.concat(
        _by(k, 31, lambda r: f'{{"check_id":"CKV_{r}"'),
        _named(k, _by(k, 17, lambda r: f',"check_name":"check {r}"')),
        _path(k, made, ',"file_path":"', '"'),
        _by(k, 200, lambda r: f',"file_line_range":[{1 + r},{1 + r + i}]'),
        F.when(k % 13 != 0, _number(k, ',"resource":"res.', '"')).otherwise(""),
        _usable_by(k, POLICY_CLASSES, ',"check_class":"{}"'),
        F.when(made["third"] == 0, _number(k, ',"guideline":"https://guide/', '"}')).when(made["third"] == 1, ',"guideline":""}').otherwise("}"),
    )


def _package_result(i: int, k: Column, key: Column, made: dict[str, Column]) -> Column:
    def versions(r: int) -> str:
        fixed = {0: f',"FixedVersion":"2.{_remainder(r, 10)}"', 1: ',"FixedVersion":""'}.get(_remainder(r, 3), "")
        return f',"InstalledVersion":"1.{_remainder(r, 10)}"' + fixed

    named = F.concat(
        F.when(made["fourth"] == 0, ',"Title":"').otherwise(_number(k, ',"Title":"vuln ', "")), _number(k, '","Description":"desc ', '"')
    )
    texts = F.when(k % 401 != 0, named).when(made["fourth"] == 0, ',"Title":""').otherwise("")
    return F.concat(
        F.lit("{"),
        _path(k, made, '"Target":"', '",'),
        _number(k, '"Vulnerabilities":[{"VulnerabilityID":"CVE-', '"'),
        _by(k, 29, lambda r: f',"PkgName":"pkg{r}"'),
        _by(k, 30, versions),
        _usable_by(k, PACKAGE_LEVELS, ',"Severity":"{}"'),
        texts,
        F.lit("}]}"),
    )


# A finding of an order without a customer.
UNNUMBERED = {
    "semgrep": '{"start":{"col":1},"end":{"col":9},"extra":{}}', "opengrep": '{"start":{"col":1},"end":{"col":9},"extra":{}}',
    "gitleaks": "{}", "checkov": '{"file_line_range":[null,null]}', "trivy": '{"Vulnerabilities":[{}]}',
}


def _document(tool: str, build: Callable[[int], Column]) -> Column:
    """The scanner's JSON for one order with the first ``n`` findings; ``build`` makes the one at a place."""
    n = F.col("n")
    made = F.concat(build(0), *[F.when(n > i, F.concat(F.lit(","), build(i))).otherwise("") for i in (1, 2)])
    unnumbered = F.array(*[F.lit(",".join([UNNUMBERED[tool]] * i)) for i in range(4)])
    items = F.when(F.col("o_custkey").isNull(), F.get(unnumbered, n)).otherwise(made)

    def inside(before: str, after: str) -> Column:
        return F.concat(F.lit(before), items, F.lit(after))

    if tool in ("semgrep", "opengrep"):
        return F.when(n.isNull(), "{}").otherwise(inside('{"results":[', "]}"))
    if tool == "gitleaks":
        return F.when(n.isNotNull(), inside("[", "]"))
    if tool == "checkov":
        # A single finding comes as a lone object, more as a list with an element without checks.
        empty, before, after = '{"results":{}}', '{"results":{"failed_checks":[', "]}}"
        ends = [F.when(n == 1, a).otherwise(b) for a, b in ((before, "[" + before), (after, f"{after},{empty}]"))]
        return F.when(n.isNull(), f"[{empty},{empty}]").otherwise(F.concat(ends[0], items, ends[1]))
    return F.when(n.isNull(), "{}").otherwise(inside('{"Results":[', ',{"Target":"none"}]}'))


def tool_reports(orders: DataFrame, tool: str) -> DataFrame:
    """One report per order: zero to three findings, some texts odd, some runs failed."""
    rank = TOOLS.index(tool)
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    build = {
        "semgrep": partial(_rule_finding, "semgrep"),
        "opengrep": partial(_rule_finding, "opengrep"),
        "gitleaks": _secret_finding,
        "checkov": _policy_finding,
        "trivy": _package_result,
    }[tool]
    sized = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", ((key + 2 * rank) % 4).cast("int").alias("n"),
        scan_root(key).alias("scan_root"),
    )
    # Each number and the root are made once, not again wherever a finding has them.
    places = {"below": F.concat("scan_root", F.lit("/src/")), "twice": F.concat("scan_root", F.lit("/nested"), "scan_root", F.lit("/src/"))}
    numbered = sized.select(
        "*",
        *[F.coalesce(customer + 7 * i + rank, F.lit(0)).alias(f"k{i}") for i in range(3)],
        *[F.coalesce(place, F.lit("")).alias(name) for name, place in places.items()],
    )
    again = {"fourth": 4, "third": 3}
    divided = numbered.select("*", *[(F.col(f"k{i}") % size).alias(f"{name}{i}") for name, size in again.items() for i in range(3)])
    shared = {name: F.col(name) for name in places}
    text = _document(tool, lambda i: build(i, F.col(f"k{i}"), key, shared | {name: F.col(f"{name}{i}") for name in again}))
    # With a lambda among them these columns are compiled as many short methods, not as a part of one for the whole stage.
    nothing = F.exists(F.array("n"), lambda n: n == 0)
    rows = divided.select(
        scan_id(key).alias("scan_id"),
        F.lit(tool).alias("tool"),
        "scan_root",
        F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("exit_code"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "SIGKILL").alias("signal"),
        F.when(nothing, pick(EMPTY_TEXTS, customer % 6)).otherwise(text).alias("stdout"),
        "o_orderstatus",
        "o_orderpriority",
    )
    if tool in ("opengrep", "trivy"):  # hosts of these scans do not have the tool
        rows = rows.filter(~((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O")))
    return rows.drop("o_orderstatus", "o_orderpriority")


def reports(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reports of every order, one frame per tool; of the ``wanted`` scans alone, their texts are made after they are chosen."""
    orders = table(spark, folder, "orders")
    if wanted is not None:
        chosen = wanted.select(F.col("scan_id").alias("wanted"))
        orders = orders.join(chosen, scan_id(F.col("o_orderkey")) == F.col("wanted"), "left_semi")
    return {tool: tool_reports(orders, tool) for tool in TOOLS}


def requested_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Tools each scan asked for: some skip a tool."""
    from scanloom.operators.conform import tools_to_run

    skip = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("checkov"), F.lit("semgrep"))).when(
        F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array().cast("array<string>")
    )
    orders = table(spark, folder, "orders")
    return orders.select(scan_id(F.col("o_orderkey")).alias("scan_id"), tools_to_run(skip).alias("tools"))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scan rows as they stand before a run."""
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        scan_id(key).alias("scan_id"),
        F.col("o_custkey").cast("int").alias("repo_id"),
        F.when(key % 4 == 0, "develop").otherwise("main").alias("branch"),
        F.when(status == "F", "completed").when(status == "P", "failed").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


# --- jobs ----------------------------------------------------------------------------------------


def job_messages(events: DataFrame) -> DataFrame:
    """One message per event; some without credentials, some with odd URLs, some unreadable."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    number = key.cast("string")
    url = (
        F.when(key % 5 == 0, F.concat(F.lit("https://github.com/org"), user.cast("string"), F.lit("/repo"), number, F.lit(".git")))
        .when(key % 5 == 1, F.concat(F.lit("git@github.com:org/repo"), number))
        .when(key % 5 == 2, F.lit("https://github.com/org/my.repo"))
        .when(key % 5 == 3, F.lit("https://example.com/org/repo"))
        .when(kind == "click", F.lit(""))
    )
    ref = F.when(user % 30 == 7, F.lit("inst-7")).otherwise((1000 + user % 30).cast("string"))
    body = F.to_json(
        F.struct(
            scan_id(key).alias("scanId"),
            (user * 11).cast("int").alias("repoId"),
            url.alias("repoUrl"),
            F.lit("main").alias("branch"),
            F.when(kind == "click", _text("tok", user)).when(kind == "error", "").alias("token"),
            F.when(kind == "view", ref).when(kind == "error", "").alias("installationId"),
        )
    )
    text = F.when(F.col("value") > 150, F.left(body, F.lit(20))).when(F.col("value") > 100, "null").otherwise(body)
    return events.select("event_id", F.col("ts").alias("arrival"), text.alias("body"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed jobs, unreadable ones flagged."""
    from scanloom.sources.jobs import parse_jobs

    return parse_jobs(job_messages(table(spark, folder, "events")))


def repos(spark: SparkSession, folder: str) -> DataFrame:
    key, nation = F.col("c_custkey").cast("int"), F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        _text("gh-", key).alias("github_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("org/"), F.col("c_name")).alias("full_name"),
        (key % 50).alias("user_id"),
        F.when(key % 7 != 0, nation % 5).alias("team_id"),
        F.when(nation % 5 != 0, nation).alias("installation_id"),
    )


def installations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.alias("id"),
        (key % 50).alias("user_id"),
        F.when(key == 7, "inst-7").otherwise((1000 + key).cast("string")).alias("installation_id"),
        F.col("n_name").alias("account_login"),
        F.when(key % 6 != 0, _text("cached", key)).alias("access_token"),
        F.timestamp_add("MINUTE", key, now()).alias("token_expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


# --- files and downloads -------------------------------------------------------------------------

SKIP_DIRS = ["node_modules", ".git"]


def files(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    middle = pick(["", "node_modules/", ".git/", ".github/", "sub/node_modules/", "", "_x/", "", "", ""], key % 10)
    name = F.when(key % 10 == 5, "node_modules").when(key % 10 == 7, ".env").otherwise(
        F.concat(key.cast("string"), F.lit(".txt"))
    )
    return table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), middle, "lang", F.lit("/"), name).alias("path"), "text", "lang"
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Downloads: web pages, archives, empty and missing files, sizes up to 6 GiB."""

    def of(rows: DataFrame, kind: str, key: str, body: str) -> DataFrame:
        k = F.col(key)
        content = (
            F.when(k % 5 == 0, F.encode(body, "UTF-8"))
            .when(k % 5 == 1, F.concat(F.lit(b"PK"), F.encode(body, "UTF-8")))
            .when(k % 5 == 2, F.lit(b""))
            .when(k % 5 == 4, F.lit(b"PK\x03\x04"))
        )
        declared = F.when(k % 5 == 4, (k % 7) * F.lit(1024 * 1024 * 1024) + F.lit(4))
        return rows.select(
            F.lit(kind).alias("kind"),
            k.alias("id"),
            F.get(F.array(F.lit(" 200\n"), F.lit("204"), F.lit("302"), F.lit("404")), (k % 4).cast("int")).alias("http_code"),
            F.coalesce(declared, F.octet_length(content).cast("bigint")).alias("size"),
            content.alias("content"),
        )

    pages = of(table(spark, folder, "pages"), "page", "page_id", "html")
    return pages.unionByName(of(table(spark, folder, "documents"), "document", "doc_id", "text"))


# --- application tables ----------------------------------------------------------------------------


def teams(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
    )


def team_members(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    return table(spark, folder, "supplier").select(
        key.alias("id"),
        key.alias("user_id"),
        (F.col("s_nationkey") % 4).alias("team_id"),
        F.when(key % 3 == 0, "owner").otherwise("member").alias("role"),
    )


def activity_logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").cast("int").alias("id"),
        (F.col("user_id") % 5).cast("int").alias("team_id"),
        F.when(F.col("event_type") != "view", F.col("user_id").cast("int")).alias("user_id"),
        F.upper("event_type").alias("action"),
        F.col("ts").alias("timestamp"),
    )


def invitations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("int")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        (F.col("c_nationkey") % 5).alias("team_id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        (key % 50).alias("invited_by"),
        F.when(F.col("c_acctbal") < 0, "expired").otherwise("pending").alias("status"),
    )


ISSUE_STATUS = {"N": "open", "A": "acknowledged", "R": "fixed"}


def stored_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issue rows as they stand in the store."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    flag = F.col("l_returnflag")
    words = ["critical", "high", "medium", "low", "info", "unknown"]
    return table(spark, folder, "lineitem").select(
        scan_id(F.col("l_orderkey")).alias("scan_id"),
        pick([*TOOLS, "other"], F.col("l_linenumber") % 6).alias("tool"),
        pick(words, F.col("l_quantity").cast("int") % 6).alias("severity"),
        F.when(part % 97 != 0, _text("rule.", part)).alias("title"),
        F.when(part % 89 != 0, _text("finding ", supplier)).alias("description"),
        F.concat(F.lit("src/"), supplier.cast("string"), F.lit(".txt")).alias("file_path"),
        F.col("l_quantity").cast("int").alias("line_start"),
        F.when(flag == "N", "open").when(flag == "A", "acknowledged").when(F.col("l_linestatus") == "F", "fixed")
        .otherwise("wontfix").alias("status"),
        F.when(flag == "R", F.timestamp_add("DAY", F.col("l_linenumber"), F.col("l_shipdate"))).alias("resolved_at"),
        F.when(flag == "R", (supplier + 5).cast("int")).alias("resolved_by"),
        F.col("l_shipdate").alias("created_at"),
    )


def stored_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Scan rows with their keys and references."""
    customer = F.col("repo_id")
    rows = scans(spark, folder)
    return rows.select(
        F.substring_index("scan_id", "_", -1).cast("int").alias("id"),
        *rows.columns,
        F.when(customer % 3 != 0, customer % 150).alias("user_id"),
        F.when(customer % 4 != 0, customer % 7).alias("team_id"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One reviewed function per document; unlabelled ones are unmarked."""
    key = F.col("doc_id")
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return docs.select(
        key.cast("int").alias("id"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("repo_id"),
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), (key % 40).cast("string"), F.lit(".py")).alias("file_path"),
        F.when(F.col("lang") != "de", "main").alias("branch"),
        F.when(F.col("lang") == "fr", F.sha2("text", 256)).otherwise(F.sha1(F.encode("text", "UTF-8"))).alias("commit_sha"),
        _text("fn", key).alias("function_name"),
        (F.col("n_chars") % 9).cast("int").alias("line_start"),
        (F.col("n_chars") % 9 + 3).cast("int").alias("line_end"),
        F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "dirty").otherwise("unmarked").alias("status"),
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """One review comment per conversation turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    written = F.timestamp_add("HOUR", (conv % 500).cast("int"), F.to_timestamp_ntz(F.lit("2023-12-01 00:00:00")))
    return table(spark, folder, "conversations").select(
        (conv * 100 + turn).cast("int").alias("id"),
        (conv % 20).cast("int").alias("repo_id"),
        F.concat(F.lit("src/"), (conv % 40).cast("string"), F.lit(".py")).alias("file_path"),
        F.length("text").alias("start_line"),
        (conv % 50).cast("int").alias("user_id"),
        (F.col("role") == "assistant").alias("resolved"),
        written.alias("created_at"),
    )


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("int").alias("user_id"),
        (F.col("user_id") % 5).cast("int").alias("team_id"),
        (F.col("event_id") % 97).cast("int").alias("total_tokens"),
        F.col("ts").alias("created_at"),
    )


def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("int")
    return table(spark, folder, "customer").select(
        key.alias("repo_id"),
        (F.col("c_mktsegment") != "BUILDING").alias("enabled"),
        (key % 5 == 0).alias("require_all_clean"),
        (key % 3).alias("max_critical_issues"),
        F.lit(1).alias("max_high_issues"),
        F.lit(40).alias("min_clean_percentage"),
        (key % 2 == 0).alias("block_on_unresolved_comments"),
    )


def scan_quotas(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    reset = F.timestamp_add("MONTH", key % 12, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return table(spark, folder, "nation").select(
        key.alias("team_id"), pick(["free", "plus", "pro"], key % 3).alias("tier"), reset.alias("reset_date")
    )


def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    words = ["clean", "dirty", "unmarked"]
    return table(spark, folder, "events").select(
        key.alias("id"),
        (F.col("user_id") % 20).cast("int").alias("repo_id"),
        _text("fn", F.col("user_id")).alias("function_name"),
        F.when(F.col("event_type") != "signup", pick(words, key % 3)).alias("previous_status"),
        pick(words, (key + F.length("event_type")) % 3).alias("new_status"),
        F.col("ts").alias("created_at"),
    )


def scan_jobs(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    started = F.when(status != "O", F.timestamp_add("SECOND", (key % 600).cast("int"), F.col("o_orderdate")))
    progress = F.to_json(
        F.struct(
            (key % 50).cast("int").alias("filesProcessed"),
            F.lit(50).alias("totalFiles"),
            (key % 7).cast("int").alias("functionsDetected"),
            F.when(status != "F", _text("src/", key)).alias("currentFile"),
        )
    )
    return table(spark, folder, "orders").select(
        F.when(status == "O", "queued").when(status == "P", "running").otherwise("completed").alias("status"),
        F.when(status != "O", progress).alias("progress"),
        F.col("o_orderdate").alias("created_at"),
        started.alias("started_at"),
        F.when(status == "F", F.timestamp_add("SECOND", (key % 900).cast("int"), started)).alias("completed_at"),
    )


def webhook_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("source"),
        F.col("props").alias("payload"),
        pick(["success", "failure", "pending", "success"], F.col("event_id") % 4).alias("status"),
        F.col("ts").alias("created_at"),
    )


def api_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    return table(spark, folder, "supplier").select(
        key.alias("id"),
        F.when(F.col("s_acctbal") >= 0, F.timestamp_add("MINUTE", F.col("s_nationkey") - 12, now())).alias("expires_at"),
    )


def catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All shaped tables by their declared names."""
    shaped = {
        "users": users, "teams": teams, "team_members": team_members, "activity_logs": activity_logs, "ai_usage_events": usage_events,
        "invitations": invitations, "github_app_installations": installations, "github_repos": repos, "code_reviews": reviews,
        "code_review_comments": comments, "code_review_status_events": status_changes, "security_scans": stored_scans,
        "security_issues": stored_issues, "scan_quotas": scan_quotas, "api_keys": api_keys, "quality_gates": quality_gates,
        "webhook_events": webhook_events, "scan_jobs": scan_jobs,
    }
    return {name: view(spark, folder) for name, view in shaped.items()}
