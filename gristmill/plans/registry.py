"""All core queries by name, and their SQL."""

from __future__ import annotations

from . import data_queries, reference_queries


def queries() -> dict:
    return reference_queries.queries() | data_queries.queries()


def oracle_sql() -> dict[str, str]:
    return reference_queries.oracle_sql() | data_queries.oracle_sql()
