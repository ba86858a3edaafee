"""Severity maps and advice texts, one per report dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.constants import RULE_ADVICE, RULE_ADVICE_DEFAULT


def rule_severity(level: Column) -> Column:
    word = F.lower(level)
    return (
        F.when(word.isin("error", "critical"), "critical")
        .when(word == "warning", "high")
        .when(word == "info", "medium")
        .when(word.isNotNull(), "low")
    )


def policy_severity(check_class: Column) -> Column:
    """Case-sensitive substring, first hit wins: 'ALLOW' contains 'LOW'."""
    return (
        F.when(check_class.contains("CRITICAL"), "critical")
        .when(check_class.contains("HIGH"), "high")
        .when(check_class.contains("MEDIUM"), "medium")
        .when(check_class.contains("LOW"), "low")
        .when(check_class.isNotNull(), "medium")
    )


def package_severity(level: Column) -> Column:
    word = F.upper(level)
    return F.when(word.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.lower(word)).when(word.isNotNull(), "info")


def secret_severity() -> Column:
    return F.lit("critical")


def rule_advice(category: Column) -> Column:
    chain = reduce(
        lambda c, kv: c.when(category.contains(kv[0]), kv[1]),
        RULE_ADVICE[1:],
        F.when(category.contains(RULE_ADVICE[0][0]), RULE_ADVICE[0][1]),
    )
    return chain.otherwise(RULE_ADVICE_DEFAULT)
