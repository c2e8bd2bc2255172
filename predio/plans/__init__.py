"""Registered queries: one module for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    from predio.plans import aggregates, cleaning, enrichment, filters, geodesic, joins, monitoring, ranking, resolution, scoring, storage  # noqa: F401
    from predio.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
