"""Collects queries and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from predio.sources.views import VIEWS_SQL

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may begin with further common table expressions after the domain views."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            body = sql.strip()
            SQL[name] = VIEWS_SQL + (body if body[:6].upper() == "SELECT" else ", " + body)
        return fn

    return add


def haversine(a: str, b: str) -> str:
    """The oracle's distance in kilometres between rows ``a`` and ``b``."""
    return f"(2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2), 1.0))))"
