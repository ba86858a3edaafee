"""scanloom: security-scan findings as Spark DataFrame pipelines."""
