"""Registered queries of the engine proper, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, forms, indexes, more  # noqa: F401  these register queries
from . import queries as registered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
