"""All queries of the time-series operators by name, and their SQL."""

from __future__ import annotations

from tidemark.plans import bars, corpus, joins, quality  # noqa: F401  register on import
from tidemark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
