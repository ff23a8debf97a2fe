"""Registered queries over the given tables."""

from frameloom.plans import albums, entitlements, hooks, layouts, people, photos, streams  # noqa: F401
from frameloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
