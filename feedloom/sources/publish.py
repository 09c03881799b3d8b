"""Marts written once, checked while they are written, and published together.

A model is computed once and written to a fresh path. Its null, value, range and reference tests
ride on that write as observed metrics; repeated keys come from a row number per key in
the same pass, which reuses the partitioning of a table already keyed by it. Later models
read the written tables. Only when every test holds do the catalog tables move to the new
paths; a table's move is one change of its location, so readers see the old or the new
table, whole. After a failed test all tables stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.session import shared_folder

REPORT = "table_name string, check_name string, column_name string, n_violations long, passed boolean"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Tests:
    """Tests of a table by column; `references` maps a column to (earlier table, key)."""

    __test__ = False

    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    """A table: how it follows from earlier ones, its tests, and whether it is published or only a step."""

    name: str
    build: Callable[[Tables], DataFrame]
    tests: Tests = Tests()
    published: bool = False


class TestsFailed(Exception):
    """Some tests failed; nothing was published. `report` has all results."""

    __test__ = False

    def __init__(self, report: list[tuple]):
        self.report = report
        super().__init__("; ".join(f"{t}.{c}: {k} {n}" for t, k, c, n, ok in report if not ok))


class Run:
    """One computation of a set of models."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.id = spark, uuid.uuid4().hex
        self.root = root or f"{shared_folder(spark)}/feedloom/marts"
        self.tables: Tables = {}
        self.paths: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.report: list[tuple] = []

    def write(self, model: Model) -> None:
        """Compute, test and write a model in one pass."""
        df, tests = model.build(self.tables), model.tests
        columns = df.columns
        checks: list[tuple[str, str, Column]] = [("not_null", c, F.col(c).isNull()) for c in tests.not_null]
        checks += [("accepted_values", c, ~F.col(c).isin(*v)) for c, v in tests.accepted.items()]
        checks += [("in_range", c, (F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in tests.ranges.items()]
        for k, c in enumerate(tests.unique):
            copies = F.row_number().over(Window.partitionBy(c).orderBy(c))
            df = df.withColumn(f"_copy{k}", copies)
            checks.append(("unique", c, F.col(c).isNotNull() & (F.col(f"_copy{k}") == 2)))     # one per repeated value
        for k, (c, (table, key)) in enumerate(tests.references.items()):
            known = self.tables[table].select(F.col(key).alias(f"_key{k}")).distinct()
            df = df.join(known, F.col(c) == F.col(f"_key{k}"), "left")
            checks.append(("relationships", c, F.col(c).isNotNull() & F.col(f"_key{k}").isNull()))
        seen = Observation(f"{model.name}-{self.id}")
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(e).alias(f"c{i}") for i, (_, _, e) in enumerate(checks)])
        path = f"{self.root}/{model.name}/{self.id}"
        df.select(*columns).write.parquet(path)
        found = seen.get
        self.report += [(model.name, name, c, found[f"c{i}"], found[f"c{i}"] == 0) for i, (name, c, _) in enumerate(checks)]
        self.counts[model.name], self.paths[model.name] = found["n"], path
        self.tables[model.name] = self.spark.read.schema(df.select(*columns).schema).parquet(path)

    def write_all(self, models: Iterable[Model]) -> Run:
        for model in models:
            self.write(model)
        return self

    def report_frame(self) -> DataFrame:
        """One row per test."""
        return self.spark.createDataFrame(self.report, REPORT)


def move_table(spark: SparkSession, table: str, df: DataFrame, path: str) -> None:
    """Let a catalog table stand at a path; one of other columns is made anew."""
    place = path.replace("'", "\\'")
    if spark.catalog.tableExists(table) and [(f.name, f.dataType) for f in spark.table(table).schema] == [(f.name, f.dataType) for f in df.schema]:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        spark.catalog.refreshTable(table)
        return
    spark.sql(f"DROP TABLE IF EXISTS {table}")      # external: its files stay
    spark.catalog.createTable(table, path=path, source="parquet", schema=df.schema)


def publish(spark: SparkSession, models: list[Model], database: str, root: str | None = None) -> Run:
    """Compute all models; publish those marked so, if every test of every model holds."""
    run = Run(spark, root).write_all(models)
    if not all(passed for *_, passed in run.report):
        raise TestsFailed(run.report)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for model in models:
        if model.published:
            move_table(spark, f"{database}.{model.name}", run.tables[model.name], run.paths[model.name])
    return run


def refresh_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...], tests: Tests = Tests()) -> dict[str, int]:
    """Replace the partitions that `df` has rows of, leave the others; tested before any is touched."""
    spark = df.sparkSession
    run = Run(spark)
    run.write(Model("refresh", lambda _: df, tests))
    if not all(passed for *_, passed in run.report):
        raise TestsFailed(run.report)
    run.tables["refresh"].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return run.counts
