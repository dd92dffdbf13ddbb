"""Runnable queries, each beside the SQL that checks it."""

from __future__ import annotations

from tidemark.plans.catalog.registry import QUERIES, SQL_CHECKS
from tidemark.plans.catalog import (  # noqa: F401  (importing registers the queries)
    sources, scalars, aggregates, joins_windows, anomalies, forecasts, budgets, validation, narrative,
)

__all__ = ["QUERIES", "SQL_CHECKS"]
