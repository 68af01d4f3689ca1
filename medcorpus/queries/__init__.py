"""One query, and SQL with the same result, per operator."""

from __future__ import annotations

from medcorpus.queries import cleaning, reports, tables  # noqa: F401
from medcorpus.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
