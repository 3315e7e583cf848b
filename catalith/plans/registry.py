"""All queries of the library outside the subpackage of its own, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("problems", "search_queries", "json_queries", "catalog_queries", "service_queries")


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"catalith.plans.{m}").QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"catalith.plans.{m}").SQL.items()}
