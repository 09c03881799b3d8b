"""Data-quality checks: each returns (table, check, column, n_violations, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("table_name", "check_name", "column_name", "n_violations", "passed")


def _rows(df: DataFrame, checks: list[tuple[str, str, Column]], table: str) -> DataFrame:
    """Turn aggregate expressions into one row per check; a single pass over `df`."""
    measured = df.agg(*[F.coalesce(e, F.lit(0)).cast("bigint").alias(f"c{i}") for i, (_, _, e) in enumerate(checks)])
    cells = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(col).alias("column_name"),
                               F.col(f"c{i}").alias("n_violations")) for i, (name, col, _) in enumerate(checks)])
    return (measured.select(F.explode(cells).alias("c")).select(F.lit(table).alias("table_name"), "c.*")
            .withColumn("passed", F.col("n_violations") == 0))


def row_checks(df: DataFrame, table: str, not_null: tuple[str, ...] = (), accepted: dict[str, list] | None = None,
               ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """All row-level checks of a table in one aggregation."""
    checks = [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null]
    checks += [("accepted_values", c, F.count_if(~F.col(c).isin(*v))) for c, v in (accepted or {}).items()]
    checks += [("in_range", c, F.count_if((F.col(c) < lo) | (F.col(c) > hi))) for c, (lo, hi) in (ranges or {}).items()]
    return _rows(df, checks, table)


def unique_check(df: DataFrame, table: str, column: str) -> DataFrame:
    """Number of values that occur more than once; counted before the shuffle."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _rows(repeated, [("unique", column, F.count_if(F.col("n") > 1))], table)


def reference_check(facts: DataFrame, table: str, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key the dimension does not know."""
    used = facts.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    orphans = used.join(dimension.select(F.col(key).alias("_k")), "_k", "left_anti")
    return _rows(orphans, [("relationships", column, F.sum("n"))], table)


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
