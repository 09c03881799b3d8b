"""Dashboard measures as grouped queries over the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.columns import ratio


def weighted(value: str, weight: str = "n_reviews", where: Column | None = None) -> Column:
    """Aggregate: volume-weighted mean, over the rows that satisfy `where`."""
    total, mass = F.col(value) * F.col(weight), F.col(weight)
    if where is not None:
        total, mass = F.when(where, total), F.when(where, mass)
    return ratio(F.sum(total), F.sum(mass))


def overview(daily: DataFrame, *by: str) -> DataFrame:
    """Review volume, rating and negative share, weighted by volume."""
    return daily.groupBy(*by).agg(F.sum("n_reviews").alias("total_reviews"), weighted("avg_rating").alias("avg_rating"),
                                  weighted("negative_share").alias("negative_share"))


def rating_trend(daily: DataFrame, days: int = 30) -> DataFrame:
    """Rating over the last `days` days of the calendar, the days before, and the change."""
    last = daily.agg(F.max("review_date")).scalar()
    age = F.datediff(F.col("_last"), F.col("review_date"))
    recent, prior = (age >= 0) & (age < days), (age >= days) & (age < 2 * days)
    return (daily.withColumn("_last", last).groupBy("app_key").agg(
                weighted("avg_rating", where=recent).alias("avg_rating_30d"),
                weighted("avg_rating", where=prior).alias("avg_rating_prior_30d"))
            .withColumn("rating_delta_30d", F.col("avg_rating_30d") - F.col("avg_rating_prior_30d")))


def topic_share(topic_daily: DataFrame, daily: DataFrame) -> DataFrame:
    """Topic reviews over all reviews; the denominator comes from the app mart once per app."""
    counts = topic_daily.groupBy("app_key", "topic").agg(F.sum("n_topic_reviews").alias("topic_reviews"))
    totals = daily.groupBy("app_key").agg(F.sum("n_reviews").alias("total_reviews"))
    return counts.join(totals, "app_key").withColumn("topic_share", ratio(F.col("topic_reviews"), F.col("total_reviews")))


def category_share(topic_daily: DataFrame, daily: DataFrame, apps: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic mentions per app and topic category, with display names from the dimensions."""
    counts = (topic_daily.join(topics, F.col("topic") == F.col("topic_key"))
              .groupBy("app_key", "category", "is_actionable_issue").agg(F.sum("n_topic_reviews").alias("topic_reviews")))
    totals = daily.groupBy("app_key").agg(F.sum("n_reviews").alias("total_reviews"))
    return (counts.join(totals, "app_key").join(apps.select("app_key", "display_name", "is_focus_app"), "app_key")
            .withColumn("share", ratio(F.col("topic_reviews"), F.col("total_reviews"))))


def release_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("n_releases"), F.count_if("impact_analysis_usable").alias("usable_releases"),
        F.count_if("is_significant").alias("significant_releases"))


def alert_measures(alerts: DataFrame) -> DataFrame:
    """Episodes and mean duration in crossed hour boundaries."""
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", "alert_start"), F.date_trunc("hour", "alert_end"))
    return alerts.groupBy("app_key").agg(F.count(F.lit(1)).alias("alert_events"),
                                         F.avg(hours.cast("double")).alias("alert_duration_hours"))


def mean_stability(backlog: DataFrame) -> DataFrame:
    return backlog.groupBy("app_key").agg(F.avg("top3_stability_pct").alias("top3_stability"))
