"""Registered queries of the engine and the SQL they must agree with."""

from __future__ import annotations

from .queries import history, library, retrieval, storage, trees, versioning

FAMILIES = (trees, retrieval, versioning, storage, library, history)


def queries() -> dict:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
