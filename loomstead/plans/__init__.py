"""Queries of the engine and the SQL they agree with."""

from loomstead.plans import audit_queries, content_queries, data_queries, dialogue_queries, engine_queries, retrieval_queries, store_queries  # noqa: F401
from loomstead.plans.registry import ORACLE, QUERIES  # noqa: F401
