"""Names of the engine's queries, their plans and their DuckDB twins."""

from __future__ import annotations

from quern.plans import profile_queries, request_queries, search_queries, text_queries

_ALL = {**search_queries.QUERIES, **profile_queries.QUERIES, **text_queries.QUERIES, **request_queries.QUERIES}


def queries() -> dict:
    return {name: plan for name, (plan, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
