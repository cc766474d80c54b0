"""All registered queries of the library but those of the llm subpackage, and their SQL."""

from __future__ import annotations

from .plans import entity_queries, file_queries, graph_queries, inventory_queries, link_queries, rule_queries, stream_queries, table_queries, text_queries  # noqa: F401  the others register their queries with graph_queries
from .plans.graph_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
