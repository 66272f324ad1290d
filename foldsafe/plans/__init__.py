"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from foldsafe.plans.registry import REGISTRY, Query

# Importing a module registers its queries.
from foldsafe.plans import (  # noqa: F401  isort: skip
    profile_queries,
    feature_queries,
    fold_queries,
    metric_queries,
    source_queries,
    ledger_queries,
    model_queries,
)

__all__ = ["REGISTRY", "Query"]
