"""Registered report queries and their DuckDB oracle SQL."""

from costlens.plans.catalog import registered_queries
from costlens.plans.oracle import oracle_queries

__all__ = ["registered_queries", "oracle_queries"]
