"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyshop.plans.registry import QUERIES, Query, oracle_text
from tallyshop.session import tune
from tallyshop.sources.retail_views import retail_catalog

MODULES = (
    "questions", "marts", "customers", "promotions", "returns", "supply", "daily", "quality", "statistics",
    "features", "forecast", "models", "sources",
)

for _module in MODULES:
    importlib.import_module(f"tallyshop.plans.{_module}")


def _runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query.build(retail_catalog(tune(spark), folder))

    run.__name__ = query.name
    return run


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(query) for name, query in QUERIES.items()}


def duckdb_queries() -> dict[str, str]:
    return {n: oracle_text(q) for n, q in QUERIES.items() if q.oracle is not None}
