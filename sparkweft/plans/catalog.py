"""All queries of the engine by name."""

from __future__ import annotations

from . import code_queries, graph_queries, learning_queries, more_queries, ranking_queries, retrieval_queries, selection_queries, semantic_queries, tree_queries

MODULES = [graph_queries, retrieval_queries, learning_queries, code_queries, selection_queries, more_queries, semantic_queries, tree_queries, ranking_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
