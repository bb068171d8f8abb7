"""All queries of the library's graph, text and conversation operators."""

from tessera.plans import graph_queries, source_queries, text_queries, time_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
