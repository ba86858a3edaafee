"""Normalisers: one per tool, all producing the same issue row, plus union and numbering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import constants as K
from scanloom.functions import severity as sev
from scanloom.functions.text import falsy_or, is_present, mask_secret, string_list, strip_root, template
from scanloom.schemas import ISSUE_FIELDS
from scanloom.sources import reports as src


@dataclass(frozen=True)
class Tool:
    """A registered scanner: how its report reads and how a finding maps to issue columns."""

    name: str
    rank: int
    dialect: src.Dialect
    normalise: Callable[[Column], dict[str, Column]]


REGISTRY: dict[str, Tool] = {}


def register(name: str, dialect: src.Dialect):
    """Add a scanner; its normaliser maps a finding struct to issue columns, omitting absent ones."""

    def add(normalise):
        if name in REGISTRY:
            raise ValueError(f"tool {name!r} is registered already")
        REGISTRY[name] = Tool(name, len(REGISTRY), dialect, normalise)
        return normalise

    return add


def extended(name: str, dialect: src.Dialect, normalise, base: dict[str, Tool] | None = None) -> dict[str, Tool]:
    """A registry with one more scanner; the shared one stays as it is."""
    tools = dict(REGISTRY if base is None else base)
    if name in tools:
        raise ValueError(f"tool {name!r} is registered already")
    return {**tools, name: Tool(name, len(tools), dialect, normalise)}


def _rule_issue(f: Column) -> dict[str, Column]:
    extra = f["extra"]
    meta = extra["metadata"]
    return {
        "severity": sev.rule_severity(extra["severity"]),
        "title": f["check_id"],
        "description": extra["message"],
        "file_path": f["path"],
        "line_start": f["start"]["line"],
        "line_end": f["end"]["line"],
        "cwe": F.when(meta["cwe"].isNotNull(), string_list(meta["cwe"])),
        "owasp": F.when(meta["owasp"].isNotNull(), string_list(meta["owasp"])),
        "recommendation": sev.rule_advice(meta["category"]),
    }


register("semgrep", src.RULES)(_rule_issue)
register("opengrep", src.RULES)(_rule_issue)


@register("gitleaks", src.SECRETS)
def _secret_issue(f: Column) -> dict[str, Column]:
    return {
        "severity": sev.secret_severity(),
        "title": template(K.SECRET_TITLE, f["RuleID"]),
        "description": f["Description"],
        "file_path": f["File"],
        "line_start": f["StartLine"],
        "line_end": f["EndLine"],
        "code": mask_secret(f["Secret"]),
        "recommendation": F.lit(K.SECRET_ADVICE),
        "owasp": F.array(F.lit(K.SECRET_OWASP)),
    }


@register("checkov", src.POLICIES)
def _policy_issue(f: Column) -> dict[str, Column]:
    lines = f["file_line_range"]
    return {
        "severity": sev.policy_severity(f["check_class"]),
        "title": f["check_name"],
        "description": template(K.POLICY_DESCRIPTION, f["resource"]),
        "file_path": f["file_path"],
        "line_start": F.get(lines, F.lit(0)),
        "line_end": F.get(lines, F.lit(1)),
        "recommendation": falsy_or(f["guideline"], F.lit(K.POLICY_ADVICE)),
        "owasp": F.array(F.lit(K.POLICY_OWASP)),
    }


@register("trivy", src.PACKAGES)
def _package_issue(f: Column) -> dict[str, Column]:
    v = f["vuln"]
    update = template("Update ", v["PkgName"], " from ", v["InstalledVersion"], " to ", v["FixedVersion"])
    watch = template("No fix available yet for ", v["PkgName"], ". Monitor for updates.")
    return {
        "severity": sev.package_severity(v["Severity"]),
        "title": template(v["VulnerabilityID"], ": ", v["PkgName"]),
        "description": falsy_or(v["Title"], v["Description"]),
        "file_path": f["Target"],
        "line_start": F.lit(1),
        "recommendation": F.when(is_present(v["FixedVersion"]), update).otherwise(watch),
        "owasp": F.array(F.lit(K.PACKAGE_OWASP)),
    }


def conform(findings: DataFrame, tool: Tool) -> DataFrame:
    """Exploded findings (scan_id, scan_root, pos, f) to issue rows, paths made relative."""
    mapped = tool.normalise(F.col("f"))
    mapped["file_path"] = strip_root(mapped["file_path"], F.col("scan_root"))
    mapped["tool"] = F.lit(tool.name)
    fields = [mapped.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ISSUE_FIELDS]
    return findings.select("scan_id", F.lit(tool.rank).alias("tool_rank"), "pos", *fields)


Reports = DataFrame | dict[str, DataFrame]


def reports_of(reports: Reports, name: str) -> DataFrame:
    """One tool's reports, from a table of all (the filter reaches the scan) or a table per tool."""
    return reports[name] if isinstance(reports, dict) else reports.filter(F.col("tool") == name)


def tool_issues(
    reports: Reports, name: str, mode: str = "strict", registry: dict[str, Tool] = REGISTRY
) -> DataFrame:
    """Issues of one tool; reports of other tools are dropped before any JSON is parsed."""
    tool = registry[name]
    read = src.read_reports(reports_of(reports, name), tool.dialect, mode)
    return conform(src.explode_findings(read), tool)


def all_issues(
    reports: Reports, mode: str = "strict", tools: list[str] | None = None, registry: dict[str, Tool] = REGISTRY
) -> DataFrame:
    """Union of every tool's issues. Overlaps between tools are kept, as reported."""
    return src.union_all([tool_issues(reports, name, mode, registry) for name in tools or registry])


def report_status(
    reports: Reports, mode: str = "strict", tools: list[str] | None = None, registry: dict[str, Tool] = REGISTRY
) -> DataFrame:
    """Outcome of every delivered report."""
    frames = []
    for name in tools or registry:
        read = src.read_reports(reports_of(reports, name), registry[name].dialect, mode)
        outcome = read.select(
            "scan_id",
            "tool",
            F.lit(registry[name].rank).alias("tool_rank"),
            "status",
            "reason",
            "n_unusable",
            F.when(F.col("findings").isNull(), 0).otherwise(F.size("findings")).alias("n_findings"),
        )
        frames.append(src.sealed(outcome, "scan_id", "tool"))
    return src.union_all(frames)


def tools_to_run(skip: Column) -> Column:
    """The registered tools in fixed order without the skipped ones."""
    tools = F.array(*[F.lit(t) for t in K.TOOLS])
    return F.array_except(tools, F.coalesce(skip, F.array().cast("array<string>")))


def run_status(requested: DataFrame, status: DataFrame) -> DataFrame:
    """Status of every requested (scan_id, tool); tools without a report are ``missing``."""
    runs = requested.select("scan_id", F.explode("tools").alias("tool"))
    return runs.join(status, ["scan_id", "tool"], "left").select(
        "scan_id",
        "tool",
        F.coalesce("status", F.lit("missing")).alias("status"),
        "reason",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )


def number_issues(issues: DataFrame, registry: dict[str, Tool] = REGISTRY) -> DataFrame:
    """Dense ordinal per scan: tools in fixed order, findings in report order.

    A finding's place is its report position plus the size of the reports before it. Only those
    sizes (one row per scan) are aggregated and joined back; no scan is ever sorted in one task,
    however many issues it has. The issues are read twice, so stored ones are the better input.
    """
    ranks = [tool.rank for tool in registry.values()]
    sizes = issues.groupBy("scan_id").agg(
        F.array(*[F.count_if(F.col("tool_rank") < rank) for rank in ranks]).alias("before")
    )
    return issues.join(sizes, "scan_id").select(
        *issues.columns, (F.get("before", F.col("tool_rank")) + F.col("pos") + 1).cast("int").alias("ordinal")
    )


def sink_rows(issues: DataFrame, created_at: Column) -> DataFrame:
    """Columns of the persisted issue table; list columns are never null."""
    empty = F.array().cast("array<string>")
    names = [name for name, _ in ISSUE_FIELDS if name not in ("cwe", "owasp")]
    return issues.select(
        "scan_id",
        *names,
        F.coalesce("cwe", empty).alias("cwe"),
        F.coalesce("owasp", empty).alias("owasp"),
        F.lit("open").alias("status"),
        created_at.alias("created_at"),
        "tool_rank",
        "pos",
    )


REQUIRED = ["scan_id", "tool", "severity", "title", "description", "file_path", "line_start"]


def failure_flags() -> list[Column]:
    """Per-scan aggregates: an issue without a path, an issue the issue table would refuse."""
    refused = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in REQUIRED])
    return [
        F.bool_or(F.col("file_path").isNull()).alias("no_path"),
        F.bool_or(refused).alias("null_field"),
    ]


def scan_failures(issues: DataFrame, scan_ids: DataFrame) -> DataFrame:
    """Scans that an unusable issue fails as a whole, with the stage it stops them at.

    ``path``: an issue without a file path, before the counters are stored.
    ``insert``: a required column is null or the scan row is unknown, after the counters are stored.
    """
    flags = issues.groupBy("scan_id").agg(*failure_flags())
    known = scan_ids.select("scan_id", F.lit(True).alias("known"))
    return (
        flags.join(known, "scan_id", "left")
        .select(
            "scan_id",
            F.when(F.col("no_path"), "path")
            .when(F.col("null_field") | F.col("known").isNull(), "insert")
            .alias("failed_at"),
        )
        .filter(F.col("failed_at").isNotNull())
    )
