"""Name -> (DataFrame builder, SQL for the result check)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans.reference_sql import statement

Builder = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Builder] = {}
STATEMENTS: dict[str, str] = {}


def register(name: str, builder: Builder, sql: str | None = None) -> None:
    BUILDERS[name] = builder
    if sql is not None:
        STATEMENTS[name] = statement(sql)
