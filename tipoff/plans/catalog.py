"""All named queries."""

from tipoff.plans import aggregate_queries, history_queries, join_queries, league_queries, model_queries, scalar_queries, source_queries  # noqa: F401
from tipoff.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
