"""Policies over nested documents against a plain evaluation of the same rules."""

import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import policies as pol
from scanloom.operators.detect import as_issues

CONFIG = "scan_id STRING, scan_root STRING, path STRING, text STRING"


def doc(*found):
    return json.dumps({"resources": [{"type": t, "name": n, "settings": s} for t, n, s in found]})


def failed(spark, rules, *texts, scan="s"):
    rows = [(scan, "/r", f"/r/{i}.json", t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, CONFIG).withColumn("type", F.lit("clash")).withColumn("body", F.lit(1))
    found = pol.nested_findings(frame, tuple(rules)).select("f.file_path", "f.resource", "f.check_id").collect()
    return sorted((p[3:-5], r, c) for p, r, c in found)


def rule(test, value=None, path="$.a.b", kind="x", ident=None):
    return pol.PathRule(ident or test, "n", "policy.HIGH", kind, path, test, value)


@pytest.mark.parametrize(
    ("test", "value", "good", "bad"),
    [
        ("equals", "true", [True, "true"], [False, None, "no", [1], {}]),
        ("differs", "no", ["yes", 1], ["no", None]),
        ("at_least", 5, [5, 6.5, "7"], [4.9, None, "many", []]),
        ("at_most", 5, [5, -1], [5.1, None]),
        ("one_of", ("p", "q"), ["p"], ["r", None]),
        ("matches", r"^v\d+$", ["v12"], ["v", None]),
        ("present", None, [0, False, "", [], {}], [None]),
        ("absent", None, [None], [0, "", [], {}]),
        ("none_of", ("pub",), [[], ["priv"], ["priv", None]], [["priv", "pub"], None, "pub"]),
        ("all_of", ("u", "v"), [["v", "w", "u"]], [["u"], [], None]),
    ],
)
def test_single_rules(spark, test, value, good, bad):
    texts = [doc(("x", f"g{i}", {"a": {"b": v}})) for i, v in enumerate(good)] + [doc(("x", f"b{i}", {"a": {"b": v}})) for i, v in enumerate(bad)]
    got = [r for _, r, _ in failed(spark, [rule(test, value)], *texts)]
    assert sorted(got) == sorted(f"x.b{i}" for i in range(len(bad)))


def test_odd_documents(spark):
    texts = [None, "", "nope", "[]", "{}", '{"resources": 5}', '{"resources": [null, 7, {"type": "x"}, {"type": "y", "name": "n"}]}']
    assert failed(spark, [rule("present")], *texts) == [("6", None, "present")]
    assert failed(spark, [rule("absent")], *texts) == []
    # A list of many resources in one long text.
    many = doc(*[("x", f"n{i}", {"a": {"b": i}, "pad": "p" * 200}) for i in range(5000)])
    assert len(failed(spark, [rule("at_least", 4000)], many)) == 4000


def test_targets(spark):
    rules = [pol.TargetRule("T", "n", "policy.LOW", "x", "$.net", pol.PathRule("", "", "", "net", "$.log.on", "equals", "true"))]
    text = doc(
        ("x", "good", {"net": "net.on"}), ("x", "off", {"net": "net.off"}), ("x", "gone", {"net": "net.none"}), ("x", "none", {}),
        ("x", "twice", {"net": "net.twice"}), ("x", "kind", {"net": "y.on"}), ("net", "on", {"log": {"on": True}}),
        ("net", "off", {"log": {"on": False}}), ("net", "twice", {}), ("y", "on", {"log": {"on": True}}),
    )
    other = doc(("net", "twice", {"log": {"on": True}}))  # declared again in another file of the scan
    assert [r for _, r, _ in failed(spark, rules, text, other)] == ["x.gone", "x.kind", "x.none", "x.off"]


def test_scans_are_apart(spark):
    rules = (pol.NeededRule("N", "n", "policy", "x", "y", "$.of"),)
    rows = [("s", "/r", "/r/1", doc(("x", "a", {}), ("x", "b", {}), ("y", "1", {"of": "x.a"}), ("y", "2", {}))), ("t", "/r", "/r/2", doc(("x", "a", {}), ("z", "1", {"of": "x.a"})))]
    found = pol.nested_findings(spark.createDataFrame(rows, CONFIG), rules)
    assert sorted(map(tuple, found.select("scan_id", "f.resource").collect())) == [("s", "x.b"), ("t", "x.a")]
    issue = as_issues(found, "checkov").where("scan_id = 't'").first()
    assert (issue["severity"], issue["file_path"]) == ("medium", "2")
    assert pol.nested_findings(spark.createDataFrame([], CONFIG), rules).isEmpty()


def test_a_document_is_parsed_once_a_branch(spark):
    rules = tuple(rule("equals", str(i), f"$.p{i}", ident=f"R{i}") for i in range(20))
    frame = spark.range(1).select(F.lit("s").alias("scan_id"), F.lit("/r").alias("scan_root"), F.lit("/p").alias("path"), F.col("id").cast("string").alias("text"))
    plan = pol.nested_findings(frame, rules)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
