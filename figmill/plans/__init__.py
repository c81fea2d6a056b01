"""Registered queries and the views they read."""

from figmill.plans import layout, records, text  # noqa: F401  they register their queries
from figmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
