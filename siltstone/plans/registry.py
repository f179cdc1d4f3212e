"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.plans import index_queries, interval_queries, review_queries, surface_queries, text_queries

QUERIES = {"p2_found": interval_queries.p2_found} | review_queries.QUERIES | text_queries.QUERIES | index_queries.QUERIES | surface_queries.QUERIES
ORACLES = {"p2_found": interval_queries.P2_SQL} | review_queries.ORACLES | text_queries.ORACLES | index_queries.ORACLES | surface_queries.ORACLES
