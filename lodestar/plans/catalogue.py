"""All registered queries and their DuckDB texts."""

from __future__ import annotations

from lodestar.plans import analytics_queries, learned_queries, maintenance_queries, more_queries, table_queries, vector_queries

PARTS = (vector_queries, more_queries, analytics_queries, maintenance_queries, table_queries, learned_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
