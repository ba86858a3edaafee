"""Row shapes: job messages, the five report dialects and the unified issue."""

from __future__ import annotations

JOB = "scanId STRING, repoId INT, repoUrl STRING, branch STRING, token STRING, installationId STRING"

# Fields that producers fill loosely (a list or a single text) are read as text first.
RULE_FINDING = (
    "STRUCT<check_id: STRING, path: STRING, `start`: STRUCT<line: INT>, `end`: STRUCT<line: INT>,"
    " extra: STRUCT<message: STRING, severity: STRING,"
    " metadata: STRUCT<cwe: STRING, owasp: STRING, category: STRING>>>"
)
RULE_REPORT = f"STRUCT<results: ARRAY<{RULE_FINDING}>>"

SECRET_FINDING = (
    "STRUCT<Description: STRING, StartLine: INT, EndLine: INT, File: STRING, Secret: STRING, RuleID: STRING>"
)
SECRET_REPORT = f"ARRAY<{SECRET_FINDING}>"

POLICY_FINDING = (
    "STRUCT<check_id: STRING, check_name: STRING, file_path: STRING, file_line_range: ARRAY<INT>,"
    " resource: STRING, check_class: STRING, guideline: STRING>"
)
POLICY_REPORT = f"ARRAY<STRUCT<results: STRUCT<failed_checks: ARRAY<{POLICY_FINDING}>>>>"

PACKAGE_FINDING = (
    "STRUCT<VulnerabilityID: STRING, PkgName: STRING, InstalledVersion: STRING, FixedVersion: STRING,"
    " Severity: STRING, Title: STRING, Description: STRING, PrimaryURL: STRING>"
)
PACKAGE_REPORT = f"STRUCT<Results: ARRAY<STRUCT<Target: STRING, Vulnerabilities: ARRAY<{PACKAGE_FINDING}>>>>"

# One report per (scan_id, tool): what a scanner printed and how it ended.
REPORT = "scan_id STRING, tool STRING, scan_root STRING, exit_code INT, signal STRING, stdout STRING"

ISSUE_FIELDS = [
    ("tool", "string"),
    ("severity", "string"),
    ("title", "string"),
    ("description", "string"),
    ("file_path", "string"),
    ("line_start", "int"),
    ("line_end", "int"),
    ("code", "string"),
    ("recommendation", "string"),
    ("cwe", "array<string>"),
    ("owasp", "array<string>"),
]
# Issue rows also say which scan they belong to and where in it they stand.
ISSUE_KEYS = [("scan_id", "string"), ("tool_rank", "int"), ("pos", "int")]
