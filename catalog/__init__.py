"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from catalog import join_queries, metric_queries, passage_queries, sample_queries, scalar_queries, source_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
