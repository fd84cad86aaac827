"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isobath.plans import daily, features, products, spatial

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (daily, spatial, features, products)

flagship = daily.monthly_anomaly


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
