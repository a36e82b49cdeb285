"""Registered queries; importing a module registers its queries."""

from entityflow.plans import collection, files, gates, governance, matching, prices, resolving, scalars, streams  # noqa: F401
from entityflow.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
