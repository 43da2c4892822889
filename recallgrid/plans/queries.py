"""All queries on the engine's own operators, with the SQL that checks them."""

from . import graph_queries, memory_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
