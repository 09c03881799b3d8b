"""Landing and loading of raw review pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.columns import share_of


def pseudonymise(pages: DataFrame, name: str = "userName", drop: tuple[str, ...] = ("userName", "userImage")) -> DataFrame:
    """Replace the reviewer by 16 hex digits of a SHA-256; a missing name hashes as the text None."""
    digest = F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("None")), 256)
    return pages.withColumn("user_hash", F.substring(digest, 1, 16)).drop(*drop)


def append_pages(pages: DataFrame, path: str, app_key: str | None = None, scraped_at=None) -> None:
    """Stamp provenance and append to the landing area, one directory per app."""
    if app_key is not None:
        pages = pages.withColumn("app_key", F.lit(app_key))
    if scraped_at is not None or "scraped_at" not in pages.columns:
        stamp = F.current_timestamp().cast("timestamp_ntz") if scraped_at is None else F.lit(scraped_at).cast("timestamp_ntz")
        pages = pages.withColumn("scraped_at", stamp)
    pages.write.mode("append").partitionBy("app_key").parquet(path)


def read_pages(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All landed pages, united by column name.

    With a declared schema columns missing from old files read as null and no
    file footers are merged; without one the footers decide.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(path)


def load_audit(raw: DataFrame) -> DataFrame:
    """Rows, distinct reviews, time span and share of missing versions per app."""
    return raw.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("reviewId").alias("n_reviews"),
        F.min("at").alias("first_review"),
        F.max("at").alias("last_review"),
        F.round(share_of(F.col("reviewCreatedVersion").isNull()), 3).alias("missing_version_share"))
