"""All queries of the library but those of the llm package, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.plans import queries_evidence, queries_flow, queries_graphs, queries_joins, queries_records, queries_report, queries_rounds, queries_scalars, queries_scores, queries_sources, queries_stores, queries_text

MODULES = (queries_scalars, queries_joins, queries_scores, queries_graphs, queries_text, queries_report, queries_evidence, queries_sources, queries_flow, queries_stores, queries_rounds, queries_records)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by level of every project and of all together."""
    return queries()["ag01_level_rollup"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: f for module in MODULES for key, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in MODULES for key, sql in module.SQL.items()}
