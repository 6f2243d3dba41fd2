"""Imports every module of queries, so that the registry is full."""

from weft.plans import crawl_queries, graph_queries, people_queries, scalar_queries, search_queries, stream_queries, triple_queries  # noqa: F401
from weft.registry import ORACLE_SQL, QUERIES  # noqa: F401
