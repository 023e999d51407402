"""All registered queries."""

from __future__ import annotations

from loadlens.plans import event_queries, metric_queries, model_queries  # noqa: F401  (they register queries)
from loadlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
