"""Importing this module registers every named query."""

from umbral.plans import estimates, geo, linkage, relational, samples  # noqa: F401
from umbral.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
