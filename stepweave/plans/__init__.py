"""Registered queries. Importing `registry` alone has none of them; this package brings them all."""

from stepweave.plans import columns, metrics, misc, planning, rollups, scoring, steps, streams  # noqa: F401
from stepweave.plans.registry import QUERIES

__all__ = ["QUERIES"]
