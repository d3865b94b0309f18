"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from stridemap.plans import answer_queries, place_queries, walk_queries

FLAGSHIP = "place_by_movement"
QUERIES = walk_queries.QUERIES | answer_queries.QUERIES | place_queries.QUERIES
ORACLE_SQL = walk_queries.ORACLE_SQL | answer_queries.ORACLE_SQL | place_queries.ORACLE_SQL
