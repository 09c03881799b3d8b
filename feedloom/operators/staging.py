"""Staging: latest copy of each review, typed columns, labels joined to reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Decides between copies scraped at the same instant. Only narrow columns: a text
# here would be read and shuffled by every query that stages reviews.
TIE_BREAK = ("reviewed_at", "rating", "thumbs_up", "app_key", "review_version")


def latest_copy(rows: DataFrame, key: str = "review_id", recency: str = "scraped_at",
                tie_break: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """Most recent row per key.

    The rank filter is pushed below the shuffle (window group limit), so each
    map task sends at most one copy per key: a key with a third of all rows
    costs its reducer only one row per map task.
    """
    newest_first = Window.partitionBy(key).orderBy(
        F.col(recency).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie_break])
    return (rows.withColumn("_copy", F.row_number().over(newest_first))
            .filter(F.col("_copy") == 1).drop("_copy"))


def stage_reviews(raw: DataFrame, tie_break: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """One typed row per review with text; the latest scrape wins."""
    # Tested after the deduplication: an empty latest copy hides older ones.
    return latest_copy(typed_reviews(raw), tie_break=tie_break).filter(F.col("text_length") > 0)


def typed_reviews(raw: DataFrame) -> DataFrame:
    """Typed columns of every copy.

    Columns are derived before the deduplication, so a query that needs only
    the length of a text or whether there is one never shuffles the text.
    """
    text = F.trim("content")
    rating = F.col("score").cast("int")
    at = F.col("at").cast("timestamp_ntz")
    return raw.select(
        F.col("reviewId").alias("review_id"),
        "app_key",
        "user_hash",
        text.alias("review_text"),
        rating.alias("rating"),
        F.col("thumbsUpCount").alias("thumbs_up"),
        F.col("reviewCreatedVersion").alias("review_version"),
        at.alias("reviewed_at"),
        at.cast("date").alias("review_date"),
        F.date_trunc("hour", at).cast("timestamp_ntz").alias("review_hour"),
        F.col("replyContent").isNotNull().alias("has_dev_reply"),
        F.length(text).alias("text_length"),
        (rating <= 2).alias("is_negative"),
        "scraped_at")


def topic_counts(topics: DataFrame) -> DataFrame:
    """One row per review and topic: highest probability and number of rows.

    Counted before the join to the reviews, a review has at most as many rows as there are topics,
    however often one was labelled. Enough for all that counts reviews by topic.
    """
    return topics.groupBy("review_id", "topic").agg(F.max("probability").alias("probability"), F.count(F.lit(1)).alias("n_rows"))


def stage_topics(topics: DataFrame, reviews: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Review-topic pairs with the review's app and dates (and `extra` columns).

    With `reviews` a written table, both sides of the join are plain exchanges, so Spark splits a
    review id with very many topic rows.
    """
    attributes = reviews.select("review_id", "app_key", "review_date", "review_hour", *extra)
    return topics.join(attributes, "review_id").select(
        "review_id", "app_key", "review_date", "review_hour", "topic", "probability", *extra)


def stage_flags(flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Churn flags with the review's app and date; as with topics, write the reviews first where an id may repeat often."""
    attributes = reviews.select("review_id", "app_key", "review_date")
    return flags.join(attributes, "review_id").select(
        "review_id", "app_key", "review_date", "churn_intent", "churn_probability")


def stage_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select("app_key", F.col("start").cast("timestamp_ntz").alias("alert_start"),
                         F.col("end").cast("timestamp_ntz").alias("alert_end"), "peak_p")


def stage_release_impact(impact: DataFrame) -> DataFrame:
    return impact.select(
        "app_key", "version", F.col("adoption_date").cast("date").alias("adoption_date"),
        "n_pre_days", "n_post_days", "usable", "real_effect", "n_placebo", "placebo_p",
        "q_value", "health_score", "is_significant")


def stage_switching(matrix: DataFrame) -> DataFrame:
    return matrix.select("source", "dest", "n", "source_total_reviews", "per_10k",
                         "per_10k_ci_low", "per_10k_ci_high")


def stage_backlog(backlog: DataFrame, manual_review_topics: tuple[str, ...]) -> DataFrame:
    """Backlog with the topics whose score a person should read first flagged."""
    return backlog.withColumn("needs_manual_review", F.col("topic").isin(*manual_review_topics))
