"""All queries of the library and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from chronolex.plans import retrieval_queries, temporal_queries, text_queries

MODULES = (text_queries, temporal_queries, retrieval_queries)


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
