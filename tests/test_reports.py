"""Report reading: poison, odd types, modes, registry, plan shape."""

import json

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.operators import conform
from scanloom.sources import reports as src

RULE = {
    "check_id": "r", "path": "/root/a.py", "start": {"line": 3}, "end": {"line": 4},
    "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": ["CWE-1"], "category": "xss"}},
}
SECRET = {"Description": "d", "StartLine": 1, "EndLine": 2, "File": "/root/f", "Secret": "abcdefghij", "RuleID": "x"}
CHECK = {
    "check_id": "C", "check_name": "n", "file_path": "/f", "file_line_range": [1, 2], "resource": "r",
    "check_class": "a.HIGH", "guideline": "",
}
VULN = {"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "HIGH", "Title": "", "Description": "d"}


def without(obj, *path):
    copy = json.loads(json.dumps(obj))
    inner = copy
    for key in path[:-1]:
        inner = inner[key]
    del inner[path[-1]]
    return copy


def rules(*f):
    return json.dumps({"results": list(f)})


def secrets(*f):
    return json.dumps(list(f))


def checks(*f):
    return json.dumps({"results": {"failed_checks": list(f)}})


def vulns(*f):
    return json.dumps({"Results": [{"Target": "go.mod", "Vulnerabilities": list(f)}]})


def frame(spark, tool, stdout, exit_code=0, signal=None):
    return spark.createDataFrame([("s", tool, "/root", exit_code, signal, stdout)], schemas.REPORT)


def outcome(spark, tool, stdout, mode="strict", **kw):
    row = conform.report_status(frame(spark, tool, stdout, **kw), mode, [tool]).first()
    return row["status"], row["n_findings"]


CASES = [
    # blank, null, scalars, empty documents
    *[(t, s, "error") for t in ("semgrep", "opengrep") for s in ("", " \n", "nope", "null", "{} x", "{},{}")],
    *[(t, s, "empty") for t in ("gitleaks", "checkov", "trivy") for s in ("", " \n\t")],
    *[(t, "null", "error") for t in ("gitleaks", "checkov", "trivy")],
    ("semgrep", "{}", "empty"), ("semgrep", "[]", "empty"), ("semgrep", "5", "empty"), ("semgrep", '{"results":null}', "empty"),
    ("semgrep", '{"results":[]}', "empty"), ("semgrep", '{"results":5}', "error"), ("semgrep", '{"results":{}}', "error"),
    ("gitleaks", "[]", "empty"), ("gitleaks", "{}", "error"), ("gitleaks", "nope", "error"), ("gitleaks", "[null]", "error"),
    ("gitleaks", "[1]", "error"), ("gitleaks", "{'a':1}", "error"),
    ("checkov", "[]", "empty"), ("checkov", "{}", "empty"), ("checkov", "nope", "error"), ("checkov", "[null]", "error"),
    ("checkov", '{"results":{"failed_checks":5}}', "empty"), ("checkov", '{"results":5}', "empty"),
    ("trivy", "nope", "empty"), ("trivy", "{}", "empty"), ("trivy", "[]", "empty"), ("trivy", '{"Results":5}', "empty"),
    ("trivy", '{"Results":[null]}', "error"), ("trivy", '{"Results":[{"Target":"a"}]}', "empty"),
    # one unusable finding voids the report
    ("semgrep", rules(RULE), "ok"), ("semgrep", rules(RULE, without(RULE, "extra")), "error"),
    ("semgrep", rules(RULE, without(RULE, "extra", "severity")), "error"), ("semgrep", rules(without(RULE, "start")), "error"),
    ("opengrep", rules(RULE, without(RULE, "end")), "error"), ("semgrep", rules(RULE, None), "error"),
    ("semgrep", rules(without(RULE, "extra", "metadata")), "ok"), ("semgrep", rules(without(RULE, "start", "line")), "ok"),
    ("gitleaks", secrets(SECRET), "ok"), ("gitleaks", secrets(SECRET, without(SECRET, "Secret")), "error"),
    ("checkov", checks(CHECK), "ok"), ("checkov", checks(CHECK, without(CHECK, "check_class")), "error"),
    ("checkov", checks(without(CHECK, "file_line_range")), "error"),
    ("trivy", vulns(VULN), "ok"), ("trivy", vulns(VULN, without(VULN, "Severity")), "error"), ("trivy", vulns(None), "error"),
]


def test_outcomes(spark):
    """All cases in one job per tool."""
    for tool in conform.REGISTRY:
        cases = [(str(i), s, want) for i, (t, s, want) in enumerate(CASES) if t == tool]
        rows = spark.createDataFrame([(i, tool, "/root", 0, None, s) for i, s, _ in cases], schemas.REPORT)
        got = {r["scan_id"]: r["status"] for r in conform.report_status(rows, tools=[tool]).collect()}
        wrong = {s: (got[i], want) for i, s, want in cases if got[i] != want}
        assert not wrong, (tool, wrong)


def replaced(obj, value, *path):
    copy = json.loads(json.dumps(obj))
    inner = copy
    for key in path[:-1]:
        inner = inner[key]
    inner[path[-1]] = value
    return copy


@pytest.mark.parametrize(
    ("tool", "wrap", "good", "path"),
    [
        ("semgrep", rules, RULE, ("extra", "severity")), ("gitleaks", secrets, SECRET, ("Secret",)),
        ("checkov", checks, CHECK, ("check_class",)), ("trivy", vulns, VULN, ("Severity",)),
    ],
)
def test_numbers_are_no_texts(spark, tool, wrap, good, path):
    """A text field that holds a number, a truth value or an object voids the report; the same in quotes does not."""
    bad = [wrap(good, replaced(good, v, *path), good) for v in (12345678901, -1.5, True, False, {"a": 1})]
    fine = [wrap(good, replaced(good, v, *path), good) for v in ("12345678901", "true", '{"a": 1}', 'x "Secret": 5')]
    escaped = wrap(good, replaced(good, 7, *path)).replace('"' + path[-1], '"\\u00%02x' % ord(path[-1][0]) + path[-1][1:])
    texts = [*bad, escaped, *fine]
    rows = spark.createDataFrame([(str(i), tool, "/root", 0, None, s) for i, s in enumerate(texts)], schemas.REPORT)
    for mode, want in (("strict", ["error"] * 6 + ["ok"] * 4), ("quarantine", ["ok"] * 10)):
        got = {r["scan_id"]: (r["status"], r["n_findings"]) for r in conform.report_status(rows, mode, [tool]).collect()}
        assert [got[str(i)][0] for i in range(len(texts))] == want, (mode, got)
        if mode == "quarantine":
            assert [got[str(i)][1] for i in range(len(texts))] == [2] * 5 + [1] + [3] * 4


def test_odd_parts_are_skipped_not_fatal(spark):
    mixed = '{"Results":[{"Target":"a","Vulnerabilities":"x"},{"Target":"b","Vulnerabilities":[%s]}]}' % json.dumps(VULN)
    issues = conform.tool_issues(frame(spark, "trivy", mixed), "trivy").collect()
    assert [(r["file_path"], r["title"]) for r in issues] == [("b", "CVE-1: p")]
    many = '[5,{"results":{"failed_checks":"x"}},{"results":{"failed_checks":[%s]}}]' % json.dumps(CHECK)
    assert conform.tool_issues(frame(spark, "checkov", many), "checkov").count() == 1


def test_quarantine_keeps_the_usable(spark):
    text = rules(RULE, without(RULE, "extra"), RULE)
    assert outcome(spark, "semgrep", text) == ("error", 0)
    assert outcome(spark, "semgrep", text, mode="quarantine") == ("ok", 2)
    kept = conform.tool_issues(frame(spark, "semgrep", text), "semgrep", "quarantine")
    assert sorted(r["pos"] for r in kept.collect()) == [0, 1]
    assert outcome(spark, "semgrep", rules(without(RULE, "extra")), mode="quarantine") == ("empty", 0)


@pytest.mark.parametrize("tool, text", [("semgrep", rules(RULE)), ("trivy", vulns(VULN)), ("gitleaks", secrets(SECRET)), ("checkov", checks(CHECK))])
def test_exit_code_and_signal(spark, tool, text):
    ignored = tool in ("gitleaks", "checkov")
    assert outcome(spark, tool, text, exit_code=1) == (("ok", 1) if ignored else ("error", 0))
    assert outcome(spark, tool, text, signal="SIGKILL") == ("terminated", 0)


def test_issue_values(spark):
    r = conform.tool_issues(frame(spark, "semgrep", rules(RULE)), "semgrep").first()
    assert (r["severity"], r["file_path"], r["line_start"], r["line_end"], r["cwe"], r["owasp"], r["code"]) == (
        "critical", "a.py", 3, 4, ["CWE-1"], None, None,
    )
    g = conform.tool_issues(frame(spark, "gitleaks", secrets(without(SECRET, "RuleID"))), "gitleaks").first()
    assert (g["title"], g["code"], g["cwe"]) == ("Secret Detected: undefined", "abcd***ghij", None)
    t = conform.tool_issues(frame(spark, "trivy", vulns(without(VULN, "PkgName"))), "trivy").first()
    assert t["title"] == "CVE-1: undefined" and t["description"] == "d" and t["line_end"] is None
    assert t["recommendation"] == "No fix available yet for undefined. Monitor for updates."
    c = conform.tool_issues(frame(spark, "checkov", checks(CHECK)), "checkov").first()
    assert c["recommendation"].startswith("Follow infrastructure") and (c["line_start"], c["line_end"]) == (1, 2)
    scalar = json.loads(rules(RULE))
    scalar["results"][0]["extra"]["metadata"]["cwe"] = "CWE-9"
    s = conform.sink_rows(
        conform.tool_issues(frame(spark, "semgrep", json.dumps(scalar)), "semgrep"), F.lit(None).cast("timestamp_ntz")
    ).first()
    assert s["cwe"] == [] and s["owasp"] == []


def test_whole_scan_failures(spark):
    no_path = frame(spark, "semgrep", rules(without(RULE, "path")))
    no_title = frame(spark, "semgrep", rules(without(RULE, "check_id")))
    fine = frame(spark, "semgrep", rules(RULE))
    known, unknown = spark.createDataFrame([("s",)], "scan_id STRING"), spark.createDataFrame([("z",)], "scan_id STRING")

    def stage(reports, scans):
        rows = conform.scan_failures(conform.tool_issues(reports, "semgrep"), scans).collect()
        return rows[0]["failed_at"] if rows else None

    assert stage(no_path, known) == "path"
    assert stage(no_title, known) == "insert"
    assert stage(fine, known) is None
    assert stage(fine, unknown) == "insert"


def test_numbering_is_dense_and_ordered(spark):
    rows = [("s", "trivy", "/root", 0, None, vulns(VULN, VULN)), ("s", "semgrep", "/root", 0, None, rules(*[RULE] * 300)),
            ("s", "gitleaks", "/root", 0, None, secrets(SECRET)), ("t", "gitleaks", "/root", 0, None, secrets(SECRET))]
    numbered = conform.number_issues(conform.all_issues(spark.createDataFrame(rows, schemas.REPORT))).collect()
    mine = sorted((r["ordinal"], r["tool"], r["pos"]) for r in numbered if r["scan_id"] == "s")
    assert [m[0] for m in mine] == list(range(1, 304))
    assert [m[1] for m in mine] == ["semgrep"] * 300 + ["gitleaks"] + ["trivy"] * 2
    assert [r["ordinal"] for r in numbered if r["scan_id"] == "t"] == [1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_are_parsed_once(spark):
    """Filters on derived columns must not pull the parse below them a second time."""
    reports = frame(spark, "gitleaks", secrets(SECRET))
    typed = "StructField(r,ArrayType(StructType(StructField(Description"
    status = conform.report_status(reports, tools=["gitleaks"]).filter("status = 'ok' AND reason IS NULL")
    assert _plan(status).count("from_json(" + typed) == 1
    assert _plan(conform.tool_issues(reports, "gitleaks").filter("severity = 'critical'")).count("from_json(" + typed) == 1


def test_tool_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "reports")
    frame(spark, "gitleaks", secrets(SECRET)).write.parquet(path)
    plan = conform.tool_issues(spark.read.parquet(path), "semgrep")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tool,semgrep)" in plan
    assert "Exchange" not in plan


def test_partitioned_reports_are_pruned(spark, tmp_path):
    path = str(tmp_path / "reports")
    src.store_reports(frame(spark, "gitleaks", secrets(SECRET)).unionByName(frame(spark, "semgrep", rules(RULE))), path)
    stored = spark.read.parquet(path)
    plan = conform.tool_issues(stored, "semgrep")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tool" in plan and "(tool" in plan.split("PartitionFilters")[1]
    assert conform.all_issues(stored).count() == 2


def test_registry_refuses_twins():
    with pytest.raises(ValueError):
        conform.register("trivy", src.PACKAGES)(lambda f: {})
    with pytest.raises(ValueError):
        conform.extended("semgrep", src.RULES, lambda f: {})
    assert list(conform.extended("llm", src.RULES, lambda f: {})) == [*conform.REGISTRY, "llm"]
    assert "llm" not in conform.REGISTRY


def test_split_reports_follow_the_same_rules(spark):
    """Row per finding: strict voids the whole report, quarantine the bad findings; a hot scan is fine."""
    good, bad = json.dumps(RULE), json.dumps(without(RULE, "extra"))
    texts = [("hot", i, good) for i in range(900)] + [("a", 0, good), ("a", 1, bad), ("b", 0, "nope"), ("b", 1, good), ("c", 0, good), ("d", 0, None)]
    rows = spark.createDataFrame(
        [(s, "semgrep", "/root", p, t) for s, p, t in texts], "scan_id STRING, tool STRING, scan_root STRING, pos INT, finding STRING"
    )
    tool = conform.REGISTRY["semgrep"]

    def counts(mode):
        issues = conform.conform(src.read_split(rows, tool.dialect, mode), tool)
        return {r["scan_id"]: r["count"] for r in issues.groupBy("scan_id").count().collect()}

    assert counts("strict") == {"hot": 900, "c": 1}
    assert counts("quarantine") == {"hot": 900, "a": 1, "b": 1, "c": 1}


def test_split_reports_are_parsed_once(spark):
    """Both sides of the join that voids reports read stored findings: each text is met once, and the join moves what is counted only."""
    good, bad = json.dumps(RULE), json.dumps(without(RULE, "start"))
    texts = [("a", 0, good), ("a", 1, bad), ("a", 1, bad), ("b", 0, good), ("b", 0, good), ("b", None, good), ("c", 7, None)]
    texts += [(None, 0, good), (None, 1, bad), ("d", 0, "[]"), ("d", 1, good), ("e", 0, without(RULE, "path")), ("f", 0, good)]
    made = [(s, "semgrep", "/root", p, t if t is None or isinstance(t, str) else json.dumps(t)) for s, p, t in texts]
    frame = spark.createDataFrame(made, "scan_id STRING, tool STRING, scan_root STRING, pos INT, finding STRING")
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    read = src.read_split(frame.mapInArrow(seen, frame.schema), src.RULES)
    assert read.columns == ["scan_id", "tool", "scan_root", "pos", "f"]
    # A report without a scan is no report: its findings meet no other.
    kept = [(r["scan_id"], r["pos"], r["f"]["path"]) for r in read.collect()]
    assert sorted(kept, key=str) == sorted(
        [("b", 0, "/root/a.py")] * 2 + [("b", None, "/root/a.py"), (None, 0, "/root/a.py"), (None, 1, "/root/a.py"), ("e", 0, None), ("f", 0, "/root/a.py")],
        key=str,
    )
    assert met.value == len(texts)
    counted = conform.conform(read, conform.REGISTRY["semgrep"]).groupBy("scan_id", "severity").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    below = plan.split("LeftAnti")[1]
    assert "from_json" not in plan and "extra.severity" in below.split("FileScan")[0]


@pytest.mark.parametrize("tool", list(conform.REGISTRY))
def test_white_space_is_looked_for_in_front_only(spark, tool):
    """A trim of both ends walks through every report's whole text."""
    status = _plan(conform.report_status(frame(spark, tool, "{}"), tools=[tool]))
    assert "ltrim(" in status and "(trim(" not in status and " trim(" not in status


def test_made_reports_have_each_number_and_root_once(spark):
    """A finding's number and the scan's root are not computed again at each mention, and no pattern goes over the text."""
    from scanloom.sources import views

    kinds = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING"
    rows = [(3, 16, "F", "1-URGENT"), (4, 4, "F", "1-URGENT"), (9, None, "F", "1-URGENT"), (None, 3, "F", "1-URGENT")]
    made = views.tool_reports(spark.createDataFrame(rows, kinds), "trivy")
    text = {r["scan_id"]: r["stdout"] for r in made.collect()}
    root = "/tmp/scan/scan_3"
    targets = [f"{root}/src/20.txt", "src/27.txt", f"{root}/nested{root}/src/34.txt", "none"]
    results = json.loads(text["scan_3"])["Results"]
    assert [r["Target"] for r in results] == targets and results[-1] == {"Target": "none"}
    assert [len(r["Vulnerabilities"]) for r in results[:-1]] == [1, 1, 1]
    assert (text["scan_4"], text["scan_9"], text[None]) == ("nope", '{"Results":[{"Vulnerabilities":[{}]},{"Target":"none"}]}', "{}")
    plan = _plan(made)
    assert "regexp_replace" not in plan and plan.count("/tmp/scan/scan_") == 1


def test_reports_are_chosen_before_their_texts_are_made(spark, tmp_path):
    """The join with the wanted scans moves orders, not texts, and the rows are those of a join with all reports."""
    from scanloom.sources import views

    kinds = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING"
    rows = [(k, 5 * k, "OFP"[k % 3], ["1-URGENT", "3-MEDIUM", "5-LOW"][k % 3]) for k in [*range(20), 3, 3]] + [(None, 1, "F", "1-URGENT")]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    wanted = spark.createDataFrame([("scan_3",), ("scan_3",), ("scan_5",), ("scan_99",), (None,), ("scan_16",)], "scan_id STRING")
    every = views.reports(spark, str(tmp_path))
    for tool, made in views.reports(spark, str(tmp_path), wanted=wanted).items():
        got, want = (sorted(map(str, r.collect())) for r in (made, every[tool].join(wanted, "scan_id", "left_semi")))
        assert got == want and len(got) >= 4
        assert "StructsToJson" not in _plan(made).split("Join LeftSemi")[1]


@pytest.mark.parametrize("tool", list(conform.REGISTRY))
def test_made_texts_are_plain_pieces(spark, tool):
    """No JSON writer and no lambda over findings; texts are JSON without nulls but in lists, also of orders without a customer."""
    from scanloom.sources import views

    kinds = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING"
    rows = [(k, c, "F", "1-URGENT") for k in range(8) for c in (0, 97, 388, 389, 401, 1234, None)]
    made = views.tool_reports(spark.createDataFrame(rows, kinds), tool)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "to_json" not in plan and "transform(" not in plan
    rank = list(conform.REGISTRY).index(tool)
    texts = [(int(r["scan_id"][5:]), r["stdout"]) for r in made.collect() if (int(r["scan_id"][5:]) + 2 * rank) % 4]
    assert len(texts) == 42
    for key, text in texts:
        document = json.loads(text)
        found = document if tool == "gitleaks" else document.get("Results", document.get("results")) if isinstance(document, dict) else document
        if tool == "checkov":
            found = (document if isinstance(document, dict) else document[0])["results"]["failed_checks"]
        assert len(found) - (tool == "trivy") == (key + 2 * rank) % 4
        assert json.dumps(document, separators=(",", ":")) == text
