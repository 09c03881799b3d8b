"""Shared intermediate frames of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.columns import stable_round
from feedloom.operators import marts, staging
from feedloom.plans import fixtures as fx
from feedloom.session import cut_lineage


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return staging.stage_reviews(fx.raw_reviews(spark, d))


def shared_reviews(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Staged reviews for queries that read them more than once: deduplicated once, narrow."""
    return cut_lineage(reviews(spark, d).select("review_id", "app_key", "review_date", *columns))


def topics(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return staging.stage_topics(fx.raw_topics(spark, d), shared_reviews(spark, d, "review_hour", *extra), extra)


def with_texts(spark: SparkSession, d: str, chosen: DataFrame) -> DataFrame:
    """The chosen rows with their reviews' texts; only those reviews are staged with texts."""
    chosen = cut_lineage(chosen)
    raw = fx.raw_reviews(spark, d)
    raw = raw.join(chosen.select(F.col("review_id").alias("reviewId")).distinct(), "reviewId", "left_semi")
    return chosen.join(staging.stage_reviews(raw).select("review_id", "review_text"), "review_id")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return marts.daily_app_metrics(reviews(spark, d))


def both_dailies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Topic mart and app mart over one staging of the reviews."""
    staged = shared_reviews(spark, d, "review_hour", "review_version", "rating", "is_negative")
    app_daily = cut_lineage(marts.daily_app_metrics(staged))
    topics = staging.stage_topics(staging.topic_counts(fx.raw_topics(spark, d)), staged)
    return cut_lineage(marts.daily_topic_metrics(topics, app_daily)), app_daily


def topic_daily(spark: SparkSession, d: str) -> DataFrame:
    return both_dailies(spark, d)[0]


def adoption(spark: SparkSession, d: str, min_reviews: int = 200) -> DataFrame:
    return marts.version_adoption(reviews(spark, d), min_reviews=min_reviews)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles cut to `digits` decimals, so summation order cannot show."""
    return df.withColumns({n: stable_round(F.col(n), digits) for n in names})
