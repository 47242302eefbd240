"""All registered queries."""

from __future__ import annotations

from crosspanel.plans import book_queries, input_queries, model_queries
from crosspanel.plans.registry import ORACLES, QUERIES

flagship = input_queries.standardized_panel

__all__ = ["ORACLES", "QUERIES", "book_queries", "flagship", "model_queries"]
