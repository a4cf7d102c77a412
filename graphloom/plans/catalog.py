"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation_queries, graph_queries, label_queries, metric_queries, point_queries, source_queries

MODULES = [point_queries, curation_queries, metric_queries, label_queries, graph_queries, source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.REGISTRY.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.REGISTRY.found.items() if sql}
