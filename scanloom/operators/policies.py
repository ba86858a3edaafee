"""Policies over nested configuration documents: rules are rows of a table, references between resources are joins.

A document is JSON of any shape with a list of ``resources`` (type, name, settings). It is parsed once to a variant value, and
a rule takes what is at its path, so that no schema has to be known and odd documents fail their rules, not the run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.credentials import spread_nulls


@dataclass(frozen=True)
class PathRule:
    """What the setting at ``path`` (``$.a.b[0]``) of each resource of ``type`` must be.

    ``test`` is one of ``equals``, ``differs``, ``at_least``, ``at_most``, ``one_of``, ``matches``, ``present``, ``absent``, ``none_of``
    (no element of a list) and ``all_of`` (each of these is in the list). A missing setting fails every test but ``absent``.
    """

    id: str
    name: str
    check_class: str
    type: str
    path: str
    test: str
    value: object = None
    guideline: str | None = None


@dataclass(frozen=True)
class TargetRule:
    """The resource of the same scan that the setting at ``path`` names as ``type.name`` must be there and pass ``target``."""

    id: str
    name: str
    check_class: str
    type: str
    path: str
    target: PathRule
    guideline: str | None = None


@dataclass(frozen=True)
class NeededRule:
    """Each resource of ``type`` must be named by the setting at ``path`` of a resource of ``by`` in the same scan."""

    id: str
    name: str
    check_class: str
    type: str
    by: str
    path: str
    guideline: str | None = None


Rule = PathRule | TargetRule | NeededRule


def resources(configs: DataFrame) -> DataFrame:
    """Documents (scan_id, scan_root, path, text) to their resources, in the order of the list (``at``).

    Text that is no JSON, or without a list of resources, has none. ``resource`` is ``type.name``, null if either is missing.
    """
    document = F.try_parse_json("text")
    listed = F.try_variant_get(document, "$.resources", "array<variant>")
    rows = configs.select("scan_id", "scan_root", "path", F.posexplode_outer(listed).alias("at", "body")).where(F.col("at").isNotNull())
    kind = F.try_variant_get("body", "$.type", "string")
    name = F.try_variant_get("body", "$.name", "string")
    return rows.select("*", kind.alias("type"), F.concat(kind, F.lit("."), name).alias("resource"))


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("body", "$.settings" + path.removeprefix("$"), kind)


def _passes(rule: PathRule) -> Column:
    text, listed = _at(rule.path, "string"), _at(rule.path, "array<string>")
    words = F.array(*[F.lit(v) for v in rule.value]) if rule.test in ("none_of", "all_of") else None
    # Made only when asked for: not every value fits every test.
    tests = {
        "equals": lambda: text == F.lit(rule.value),
        "differs": lambda: text != F.lit(rule.value),
        "at_least": lambda: _at(rule.path, "double") >= F.lit(rule.value),
        "at_most": lambda: _at(rule.path, "double") <= F.lit(rule.value),
        "one_of": lambda: text.isin(*rule.value),
        "matches": lambda: text.rlike(rule.value),
        "present": lambda: text.isNotNull() | listed.isNotNull() | _at(rule.path, "map<string,variant>").isNotNull(),
        "absent": lambda: ~(text.isNotNull() | listed.isNotNull() | _at(rule.path, "map<string,variant>").isNotNull()),
        "none_of": lambda: ~F.arrays_overlap(F.array_compact(listed), words),
        "all_of": lambda: F.size(F.array_except(words, listed)) == 0,
    }
    return F.coalesce(tests[rule.test](), F.lit(False))


def _finding(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.id).alias("check_id"),
        F.lit(rule.name).alias("check_name"),
        F.col("path").alias("file_path"),
        F.array(F.lit(1), F.lit(1)).alias("file_line_range"),
        F.col("resource"),
        F.lit(rule.check_class).alias("check_class"),
        F.lit(rule.guideline).cast("string").alias("guideline"),
    )


def _by_type(rules: list, entry) -> Column:
    """An array of the entries of the rules for the row's type; a row meets the rules of its own type only."""
    cases = None
    for kind in dict.fromkeys(r.type for r in rules):
        found = F.array_compact(F.array(*[entry(r) for r in rules if r.type == kind]))
        cases = F.when(F.col("type") == kind, found) if cases is None else cases.when(F.col("type") == kind, found)
    return cases


_PLACE = ["scan_id", "scan_root", "at"]


def nested_findings(configs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents to failed checks in the policy dialect, one row for each resource and rule it fails.

    Resources are named within a scan; where one name is declared several times, a target passes if any declaration does.
    References that are missing or name nothing fail. Rules about a single resource need no shuffle. References meet what their
    targets say, which is a row for each name and rule, so a target that a third of all resources name is one row.
    """
    found = resources(configs)
    parts = []
    single = [r for r in rules if isinstance(r, PathRule)]
    if single:
        checks = _by_type(single, lambda r: F.when(~_passes(r), _finding(r)))
        parts.append(found.select(*_PLACE, F.explode_outer(checks).alias("f")).where(F.col("f").isNotNull()))

    to_target = [r for r in rules if isinstance(r, TargetRule)]
    if to_target:
        asked = _by_type(to_target, lambda r: F.struct(F.lit(r.id).alias("rule"), _at(r.path, "string").alias("target"), _finding(r).alias("f")))
        refs = found.select(*_PLACE, F.explode_outer(asked).alias("e")).where(F.col("e").isNotNull()).select(*_PLACE, "e.*")
        key = spread_nulls(F.col("target"), F.xxhash64("scan_root", "f", "at"))
        refs = refs.withColumn("target", key)
        said = F.array(
            *[F.when(F.col("type") == r.target.type, F.struct(F.lit(r.id).alias("rule"), _passes(r.target).alias("ok"))) for r in to_target]
        )
        facts = found.where(F.col("resource").isNotNull()).select("scan_id", F.col("resource").alias("target"), F.explode(F.array_compact(said)).alias("s"))
        facts = facts.groupBy("scan_id", "target", F.col("s.rule").alias("rule")).agg(F.bool_or("s.ok").alias("ok"))
        judged = refs.join(facts, ["scan_id", "target", "rule"], "left")
        parts.append(judged.where(~F.coalesce("ok", F.lit(False))).select(*_PLACE, "f"))

    needed = [r for r in rules if isinstance(r, NeededRule)]
    if needed:
        wants = _by_type(needed, lambda r: F.struct(F.lit(r.id).alias("rule"), _finding(r).alias("f")))
        wanted = found.select(*_PLACE, "resource", F.explode_outer(wants).alias("e")).where(F.col("e").isNotNull())
        wanted = wanted.select(*_PLACE, F.col("e.rule").alias("rule"), F.col("e.f").alias("f"), spread_nulls(F.col("resource"), F.xxhash64("scan_root", "e", "at")).alias("target"))
        names = F.array(
            *[F.when(F.col("type") == r.by, F.struct(F.lit(r.id).alias("rule"), _at(r.path, "string").alias("target"))) for r in needed]
        )
        named = found.select("scan_id", F.explode(F.array_compact(names)).alias("n")).select("scan_id", "n.*").where(F.col("target").isNotNull()).distinct()
        parts.append(wanted.join(named, ["scan_id", "rule", "target"], "left_anti").select(*_PLACE, "f"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("nth", F.lit(0)).select("scan_id", "scan_root", "at", "nth", "f")
