"""Scanners over tables: secrets, patterns, policies and package advisories.

Rules are data of this package, plain public patterns; they do not imitate any scanner's rule base.
Each scanner gives findings in the shape of a report dialect, so the normalisers apply unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.conform import REGISTRY, conform


@dataclass(frozen=True)
class SecretRule:
    id: str
    pattern: str
    group: int
    description: str


@dataclass(frozen=True)
class PatternRule:
    id: str
    pattern: str
    severity: str
    message: str
    category: str
    cwe: tuple[str, ...] = ()
    owasp: tuple[str, ...] = ()
    language: str | None = None


@dataclass(frozen=True)
class Policy:
    id: str
    name: str
    check_class: str
    passed: Callable[[], Column]
    guideline: str | None = None


SECRET_RULES = (
    SecretRule(
        "quoted-credential",
        r'(?i)(password|passwd|secret|token|api[_-]?key)\s*[=:]\s*"([^"]+)"',
        2,
        "Credential in quotes",
    ),
    SecretRule("hex-token", r"\b([0-9a-f]{40})\b", 1, "Forty hexadecimal digits"),
)

PATTERN_RULES = (
    PatternRule(
        "inline-script", r"<script[^>]*>", "WARNING", "Script inside the page", "xss", ("CWE-79",), ("A03:2021",), "html"
    ),
    PatternRule("inline-style", r"<style[^>]*>", "INFO", "Style inside the page", "style", language="html"),
    PatternRule("license-line", r"\bLicensed under\b", "INFO", "License text", "license"),
    PatternRule("weak-digest", r"(?i)\b(md5|sha1)\b", "ERROR", "Weak digest named", "crypto", ("CWE-328",)),
)


def lines(files: DataFrame, wanted: Column) -> DataFrame:
    """Lines of the files that match anywhere; the others are never split."""
    rows = files.filter(wanted).select(
        *[c for c in files.columns if c != "text"], F.posexplode_outer(F.split("text", "\n")).alias("at", "line")
    )
    return rows.filter(F.col("line").isNotNull())


def _any_match(patterns: list[str]) -> Column:
    """Coarse test on the whole text; multi-line mode keeps anchors meaning line ends."""
    test = F.lit(False)
    for pattern in patterns:
        test = test | F.col("text").rlike(f"(?m){pattern}")
    return test


def _hits(rows: DataFrame, per_rule: list[Column]) -> DataFrame:
    """One row per hit; ``per_rule`` are arrays of finding structs built from the line."""
    found = F.concat(*per_rule) if len(per_rule) > 1 else per_rule[0]
    exploded = rows.select("scan_id", "scan_root", "at", F.posexplode_outer(found).alias("nth", "f"))
    return exploded.filter(F.col("nth").isNotNull())


def secret_findings(files: DataFrame, rules: tuple[SecretRule, ...] = SECRET_RULES) -> DataFrame:
    """Files (scan_id, scan_root, path, text) to findings in the secret dialect, line by line."""
    rows = lines(files.select("scan_id", "scan_root", "path", "text"), _any_match([r.pattern for r in rules]))
    line_no = (F.col("at") + 1).cast("int")

    def hits(rule: SecretRule) -> Column:
        return F.transform(
            F.regexp_extract_all("line", F.lit(rule.pattern), F.lit(rule.group)),
            lambda secret: F.struct(
                F.lit(rule.description).alias("Description"),
                line_no.alias("StartLine"),
                line_no.alias("EndLine"),
                F.col("path").alias("File"),
                secret.alias("Secret"),
                F.lit(rule.id).alias("RuleID"),
            ),
        )

    return _hits(rows, [hits(rule) for rule in rules])


def pattern_findings(files: DataFrame, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Files (scan_id, scan_root, path, language, text) to findings in the rule dialect.

    The rules are unrolled into one expression per line, so no line is joined with a rule table.
    """
    kept = files.select("scan_id", "scan_root", "path", "language", "text")
    rows = lines(kept, _any_match([r.pattern for r in rules]))
    line_no = (F.col("at") + 1).cast("int")
    place = F.struct(line_no.alias("line"))

    def hits(rule: PatternRule) -> Column:
        applies = F.lit(True) if rule.language is None else F.col("language") == rule.language
        text = F.when(applies, F.col("line")).otherwise("")
        as_json = lambda words: F.lit("[" + ",".join(f'"{w}"' for w in words) + "]")
        finding = F.struct(
            F.lit(rule.id).alias("check_id"),
            F.col("path"),
            place.alias("start"),
            place.alias("end"),
            F.struct(
                F.lit(rule.message).alias("message"),
                F.lit(rule.severity).alias("severity"),
                F.struct(
                    as_json(rule.cwe).alias("cwe"), as_json(rule.owasp).alias("owasp"), F.lit(rule.category).alias("category")
                ).alias("metadata"),
            ).alias("extra"),
        )
        return F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda _: finding)

    return _hits(rows, [hits(rule) for rule in rules])


def policy_findings(configs: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """Configuration rows (scan_id, scan_root, path, resource, settings…) to failed checks."""

    def check(policy: Policy) -> Column:
        failed = F.struct(
            F.lit(policy.id).alias("check_id"),
            F.lit(policy.name).alias("check_name"),
            F.col("path").alias("file_path"),
            F.array(F.lit(1), F.lit(1)).alias("file_line_range"),
            F.col("resource"),
            F.lit(policy.check_class).alias("check_class"),
            F.lit(policy.guideline).cast("string").alias("guideline"),
        )
        return F.when(~F.coalesce(policy.passed(), F.lit(False)), failed)

    checks = F.array_compact(F.array(*[check(p) for p in policies]))
    rows = configs.select("scan_id", "scan_root", F.lit(0).alias("at"), F.posexplode_outer(checks).alias("nth", "f"))
    return rows.filter(F.col("nth").isNotNull())


def version_key(version: Column) -> Column:
    """Comparable form of a dotted version; null for null.

    A leading v and build marks are dropped, missing parts count as zero (1.0 is 1.0.0), parts that are no
    number as well, and a pre-release (1.0.0-rc1) comes before its release.
    """
    bare = F.regexp_replace(F.trim(version), r"^[vV]|\+.*$", "")
    parts = F.split(F.split(bare, "-", 2)[0], r"\.")
    numbers = F.transform(parts, lambda part: F.coalesce(part.try_cast("int"), F.lit(0)))
    used = F.array_max(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1).otherwise(F.lit(0))))
    label = F.get(F.split(bare, "-", 2), F.lit(1))
    key = F.struct(
        F.slice(numbers, F.lit(1), used).alias("numbers"), label.isNull().alias("released"), F.coalesce(label, F.lit("")).alias("label")
    )
    return F.when(version.isNotNull(), key)


def advisory_findings(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages (scan_id, scan_root, path, name, version) joined with the advisories that cover them.

    An equi join on the name with the version range on top; whether the advisories are broadcast is
    left to their measured size.
    """
    adv = advisories.select(
        F.col("name").alias("__name"),
        F.col("id").alias("__id"),
        "severity",
        "title",
        "fixed",
        version_key(F.col("introduced")).alias("__from"),
        version_key(F.col("fixed")).alias("__to"),
    )
    at = version_key(F.col("version"))
    covered = (F.col("name") == F.col("__name")) & (F.col("__from") <= at) & (F.col("__to").isNull() | (at < F.col("__to")))
    vuln = F.struct(
        F.col("__id").alias("VulnerabilityID"),
        F.col("name").alias("PkgName"),
        F.col("version").alias("InstalledVersion"),
        F.col("fixed").alias("FixedVersion"),
        F.col("severity").alias("Severity"),
        F.col("title").alias("Title"),
        F.lit("").alias("Description"),
    )
    return packages.join(adv, covered).select(
        "scan_id", "scan_root", F.lit(0).alias("at"), F.lit(0).alias("nth"),
        F.struct(F.col("path").alias("Target"), vuln.alias("vuln")).alias("f"),
    )


def as_issues(findings: DataFrame, tool: str) -> DataFrame:
    """Findings to issue rows; ``pos`` is the line index, not a report position."""
    return conform(findings.select("scan_id", "scan_root", F.col("at").alias("pos"), "f"), REGISTRY[tool])
