"""All registered queries of the library's general part."""

from __future__ import annotations

from . import file_queries, profile_queries, relational_queries, rental_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
