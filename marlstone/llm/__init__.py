"""Operators for large-scale training-data pipelines. Nothing else in the library imports this subpackage."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
