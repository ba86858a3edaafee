"""Registered queries by family."""

from scanloom.plans import analytics, detect, integrity, jobs, reports, streams  # noqa: F401
from scanloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
