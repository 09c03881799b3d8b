"""CSV, JSON and YAML inputs, table replacement and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.sources import schemas

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV whose fields may hold newlines and doubled quotes."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_label_batches(spark: SparkSession, paths, schema: str = schemas.TOPIC_LABEL_BATCH,
                       arrays: bool = True) -> DataFrame:
    """Label records from JSON arrays (or from JSON lines); a path may be a glob or a list of files."""
    return spark.read.schema(schema).option("multiLine", str(arrays).lower()).json(paths)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident log with parsed times; `apps_affected` stays a ';' list."""
    return stage_incidents(read_csv(spark, path, schemas.INCIDENTS_CSV))


def stage_incidents(log: DataFrame) -> DataFrame:
    def parse(name: str) -> Column:
        return F.to_timestamp_ntz(F.col(name), F.lit("yyyy-MM-dd HH:mm")).alias(name)

    return log.select("incident_id", "apps_affected", parse("start_time_ist"),
                      parse("first_public_report_ist"), "type", "notes")


def incident_apps(incidents: DataFrame) -> DataFrame:
    """One row per incident and affected app."""
    return incidents.withColumn("app_key", F.explode(F.split("apps_affected", ";")))


def read_dictionary(path: str) -> dict:
    """A small YAML dictionary (app list, alias groups) for use in expressions."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def replace_table(df: DataFrame, table: str, constants: dict | None = None) -> None:
    """Idempotent overwrite of a result table, with constant columns added."""
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").saveAsTable(table)


def replace_path(df: DataFrame, path: str, constants: dict | None = None,
                 partition_by: tuple[str, ...] = ()) -> None:
    """The same for a parquet path."""
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def export_csv(tables: dict[str, DataFrame], folder: str, sort: dict[str, list] | None = None) -> dict[str, int]:
    """Write each table as CSV with a header and return its row count.

    Rows are counted by an observation of the write itself, so no table is
    scanned twice. Files are sorted within, not across, partitions.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"export_{name}")
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if sort and name in sort:
            counted = counted.sortWithinPartitions(*sort[name])
        counted.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{folder}/{name}")
        counts[name] = seen.get["n"]
    return counts
