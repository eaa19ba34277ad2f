"""All queries and their SQL, by the name under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregate_queries, area_queries, drawing_queries, graph_queries, join_queries, learning_queries, overlay_queries, planning_queries, region_queries, scalar_queries, sheet_queries

MODULES = [scalar_queries, join_queries, aggregate_queries, graph_queries, area_queries, planning_queries, drawing_queries, sheet_queries, overlay_queries, learning_queries, region_queries]
FLAGSHIP = "signature_catalog"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
