"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from docspark.plans import block_queries, graph_queries, index_queries, lineage_queries, retrieval_queries, session_queries, text_queries  # noqa: F401
from docspark.plans.base import ORACLE, QUERIES  # noqa: F401
