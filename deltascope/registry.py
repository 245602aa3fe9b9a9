"""Registered queries and their SQL oracles, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import MODULES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for module in MODULES for name, (build, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
