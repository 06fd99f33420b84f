"""All queries over the driver's tables for the operators of this library, with the SQL that each is held against."""

from __future__ import annotations

from roadloom.plans import geo_queries, graph_queries, history_queries, match_queries, place_queries, service_queries, tag_queries
from roadloom.plans.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "geo_queries", "graph_queries", "history_queries", "match_queries", "place_queries", "query", "service_queries", "tag_queries"]
