"""Registered queries over the given tables and the SQL that checks them; names begin with the operator's survey id."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("evaluation", "tokens", "links", "structures", "more")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in import_module(f"gneiss.catalog.{m}").found.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in import_module(f"gneiss.catalog.{m}").found.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["entry_fold_metrics"](spark, sf_dir)
