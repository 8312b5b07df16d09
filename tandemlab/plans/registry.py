"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemlab.plans import agent_queries, breadth_queries, data_queries, endpoint_queries, resampling_queries

_MODULES = (endpoint_queries, resampling_queries, data_queries, agent_queries, breadth_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
