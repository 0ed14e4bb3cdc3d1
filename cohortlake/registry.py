"""All queries of the interval and genotyping operators, with their SQL."""

from __future__ import annotations

from .functions import queries as functions
from .operators import queries_depth, queries_evidence, queries_intervals
from .plans import queries as plans
from .sources import queries as sources

_PARTS = (functions, queries_intervals, queries_depth, queries_evidence, plans, sources)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
