"""Queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ("ranking", "texts", "segments", "tables", "records", "streams")


def query(sql: str | None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL twin if it has one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"folioforge.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
