"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import episode_queries, fold_queries, planning_queries, script_queries, telemetry_queries, text_queries, transcript_queries

_MODULES = (episode_queries, script_queries, telemetry_queries, planning_queries, text_queries, fold_queries, transcript_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = QUERIES["script_turns"]
