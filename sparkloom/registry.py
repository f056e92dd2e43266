"""Queries of the relational engine and their SQL."""

from __future__ import annotations

from sparkloom.queries import access, aggregates, joins, plans, scans  # noqa: F401  they register themselves
from sparkloom.queries.base import QUERIES, SQL

FLAGSHIP = "flagship_distinct_join"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
