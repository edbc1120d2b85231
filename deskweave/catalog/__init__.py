"""Every operator wired to the test tables, next to its SQL twin."""

from . import compositions, links, metrics, retrieval, sampling, scoring, sources, text  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
