"""All registered queries of the analytics engine and their SQL counterparts."""

from .plans import graph_queries, relational_queries, report_queries, run_queries, source_queries, statistics_queries, vector_queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "relational_queries", "report_queries", "run_queries", "source_queries", "statistics_queries", "vector_queries"]
