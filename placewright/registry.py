"""All queries of the place engine and their DuckDB twins."""

from __future__ import annotations

from placewright.queries import catalog, chat, limits, matching, planning, search


def _all() -> dict:
    return search.QUERIES | catalog.QUERIES | limits.QUERIES | planning.QUERIES | matching.QUERIES | chat.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
