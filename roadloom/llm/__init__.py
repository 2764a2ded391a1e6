"""Operators of a training-data pipeline; nothing else in the package imports them."""

from roadloom.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
