"""Words, texts and limits that results must carry exactly."""

TOOLS = ["semgrep", "opengrep", "gitleaks", "checkov", "trivy"]
ISSUE_TOOLS = ["semgrep", "opengrep", "gitleaks", "checkov", "trivy", "llm"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
REVIEW_STATUSES = ["clean", "dirty", "unmarked"]
SCAN_STATUSES = ["running", "completed", "failed"]
ISSUE_STATUSES = ["open", "acknowledged", "fixed", "false_positive"]
JOB_STATUSES = ["queued", "running", "completed", "failed", "cancelled"]
WEBHOOK_STATUSES = ["success", "failure", "pending"]

# Recommendation texts by category, tested in this order.
RULE_ADVICE = [
    ("injection", "Use parameterized queries or prepared statements to prevent injection attacks."),
    ("xss", "Sanitize and escape user input before rendering. Use a templating engine with auto-escaping."),
    ("crypto", "Use industry-standard cryptographic libraries. Avoid deprecated algorithms like MD5 or SHA1."),
]
RULE_ADVICE_DEFAULT = (
    "Review the code and apply security best practices. "
    "Consult OWASP guidelines for specific recommendations."
)
SECRET_TITLE = "Secret Detected: "
SECRET_ADVICE = (
    "Immediately rotate this secret and remove it from version control history. "
    "Use environment variables or secret management services."
)
SECRET_OWASP = "A02:2021-Cryptographic Failures"
POLICY_DESCRIPTION = "Infrastructure misconfiguration detected in "
POLICY_ADVICE = "Follow infrastructure security best practices. Review cloud provider security documentation."
POLICY_OWASP = "A05:2021-Security Misconfiguration"
PACKAGE_OWASP = "A06:2021-Vulnerable and Outdated Components"

# Job error texts.
ERR_NO_URL = "Repository URL is required"
ERR_BAD_URL = "Invalid GitHub repository URL"
ERR_NO_INSTALLATION = "Installation not found: "
ERR_BAD_INSTALLATION = "Invalid installation ID: "
ERR_FALLBACK = "Processing failed"

# Limits.
MAX_ARCHIVE_BYTES = 5 * 1024 * 1024 * 1024
TOKEN_MARGIN_MINUTES = 5
RETENTION_HOURS = 1

# White space as JavaScript's trim() knows it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)
