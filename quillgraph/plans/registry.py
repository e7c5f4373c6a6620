"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from . import feed_queries, index_queries, oracles, page_queries, queries, worker_queries

FLAGSHIP = "hybrid_fusion"
QUERIES = queries.QUERIES | page_queries.QUERIES | worker_queries.QUERIES | index_queries.QUERIES | feed_queries.QUERIES
ORACLES = oracles.ORACLES | page_queries.ORACLES | worker_queries.ORACLES | index_queries.ORACLES | feed_queries.ORACLES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
