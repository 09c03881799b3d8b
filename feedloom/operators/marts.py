"""Daily marts, release dates and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import ratio, share_of
from feedloom.functions.seeded import seeded_digest
from feedloom.session import cut_lineage
from feedloom.sources import schemas

INCOMPLETE_DAYS = 2


def is_complete(last_date: Column, date: Column, days: int = INCOMPLETE_DAYS) -> Column:
    """Stores index reviews late, so an app's last days are still filling up."""
    return date <= F.date_sub(last_date, days)


def day_cells(reviews: DataFrame) -> DataFrame:
    """Counts and rating sums per app, day and version.

    The daily mart, the release dates and the rollout comparison all follow
    from these rows, so one pass over the reviews serves the three.
    """
    rating = F.col("rating").cast("double")
    return reviews.groupBy("app_key", "review_date", "review_version").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rating).alias("s"), F.sum(rating * rating).alias("ss"),
        F.count_if("is_negative").alias("n_negative"))


def daily_app_metrics(reviews: DataFrame) -> DataFrame:
    """Volume, mean rating, negative share and 7-row trailing mean per app and day."""
    return daily_from_cells(day_cells(reviews))


def daily_from_cells(cells: DataFrame) -> DataFrame:
    days = cells.groupBy("app_key", "review_date").agg(
        F.sum("n").alias("n_reviews"), (F.sum("s") / F.sum("n")).alias("avg_rating"),
        (F.sum("n_negative") / F.sum("n")).alias("negative_share"))
    app = Window.partitionBy("app_key")
    trailing = app.orderBy("review_date").rowsBetween(-6, Window.currentRow)
    return days.select(
        "app_key", "review_date", "n_reviews", "avg_rating", "negative_share",
        F.avg("avg_rating").over(trailing).alias("avg_rating_7d"),
        is_complete(F.max("review_date").over(app), F.col("review_date")).alias("is_complete_day"))


def version_adoption(reviews: DataFrame, min_share: float = 0.05, min_reviews: int = 200,
                     incomplete_days: int = INCOMPLETE_DAYS) -> DataFrame:
    """Release dates inferred from the reviews.

    A version counts as adopted on the first complete day it holds `min_share`
    of its app's versioned reviews.
    """
    return adoption_from_cells(cut_lineage(day_cells(reviews)), min_share, min_reviews, incomplete_days)


def adoption_from_cells(cells: DataFrame, min_share: float = 0.05, min_reviews: int = 200,
                        incomplete_days: int = INCOMPLETE_DAYS) -> DataFrame:
    """The same from day cells, which are read twice: a written table serves best."""
    # The cutoff counts versionless reviews, the share does not.
    last = cells.groupBy("app_key").agg(F.max("review_date").alias("_last"))
    complete = (cells.join(last, "app_key")
                .filter(F.col("review_version").isNotNull()
                        & is_complete(F.col("_last"), F.col("review_date"), incomplete_days)))
    day_total = F.sum("n").over(Window.partitionBy("app_key", "review_date"))
    shares = complete.withColumn("version_share", F.col("n").cast("double") / day_total)
    return (shares.groupBy("app_key", "review_version").agg(
                F.min(F.when(F.col("version_share") >= min_share, F.col("review_date"))).alias("adoption_date"),
                F.min("review_date").alias("first_seen_date"),
                F.sum("n").alias("total_reviews"))
            .filter(F.col("adoption_date").isNotNull() & (F.col("total_reviews") >= min_reviews)))


def daily_topic_metrics(topics: DataFrame, daily: DataFrame) -> DataFrame:
    """Distinct reviews per app, day and topic, with the day's volume beside it."""
    counted = topics.groupBy("app_key", "review_date", "topic").agg(
        F.countDistinct("review_id").alias("n_topic_reviews"))
    day = daily.select("app_key", "review_date", F.col("n_reviews").alias("n_reviews_that_day"), "is_complete_day")
    return counted.join(day, ["app_key", "review_date"]).select(
        "app_key", "review_date", "topic", "n_topic_reviews", "n_reviews_that_day",
        F.round(ratio(F.col("n_topic_reviews"), F.col("n_reviews_that_day")), 4).alias("topic_share"),
        "is_complete_day")


def topic_quality_metrics(topics: DataFrame, flags: DataFrame) -> DataFrame:
    """Topic mart with the mean rating and churn rate of the topic's reviews.

    `topics` carries `rating`. A review without a flag counts as not leaving.
    """
    churn = flags.select("review_id", "churn_intent")
    return (topics.join(churn, "review_id", "left")
            .groupBy("app_key", "review_date", "topic").agg(
                F.countDistinct("review_id").alias("n_topic_reviews"),
                F.avg("rating").alias("avg_rating_topic"),
                share_of(F.coalesce(F.col("churn_intent"), F.lit(False))).alias("churn_intent_rate")))


def dim_date(reviews: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last review."""
    span = reviews.agg(F.min("review_date").alias("lo"), F.max("review_date").alias("hi"))
    day = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    dow = F.dayofweek("date") - 1
    return day.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        dow.alias("day_of_week"), dow.isin(0, 6).alias("is_weekend"))


def dim_app(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.DIM_APP)


def dim_topic(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.DIM_TOPIC)


def dim_version(adoption: DataFrame, impact: DataFrame) -> DataFrame:
    """Releases with the impact results where there are any."""
    results = impact.select(
        "app_key", F.col("version").alias("review_version"),
        F.col("usable").alias("impact_analysis_usable"), "real_effect", "q_value", "is_significant")
    return adoption.join(results, ["app_key", "review_version"], "left").select(
        "app_key", "review_version", "adoption_date", "total_reviews",
        "impact_analysis_usable", "real_effect", "q_value", "is_significant")


def worst_rated(topics: DataFrame, per_group: int = 8) -> DataFrame:
    """Rows that can be among the first `per_group` of their app, topic and month by rating, worst first.

    Ratings are counted first; where the worse ones fill a group, its other rows need not be ranked.
    The rows are read twice: a written table serves best.
    """
    keys = {"_app": F.col("app_key"), "_topic": F.col("topic"), "_month": F.date_format("review_date", "yyyy-MM")}
    worse = Window.partitionBy(*keys).orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
    needed = (topics.groupBy(*[c.alias(k) for k, c in keys.items()], "rating").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_worse", F.coalesce(F.sum("_n").over(worse), F.lit(0)))
              .filter(F.col("_worse") < per_group).groupBy(*keys).agg(F.max("rating").alias("_last")))
    same_group = [c.eqNullSafe(F.col(k)) for k, c in keys.items()]
    return (topics.join(cut_lineage(needed), same_group).filter(F.col("rating").isNull() | (F.col("rating") <= F.col("_last")))
            .select(*topics.columns))


def review_samples(topics: DataFrame, per_group: int = 8, seed: int = 8) -> DataFrame:
    """Up to `per_group` example reviews per app, topic and month, worst ratings first.

    `topics` carries `rating`; texts are joined afterwards, to the chosen ids only.
    The rank limit runs before the shuffle, so only `per_group` rows per group
    leave each map task.
    """
    month = F.date_format("review_date", "yyyy-MM")
    worst_first = Window.partitionBy("app_key", "topic", "year_month").orderBy(
        "rating", seeded_digest(seed, F.col("review_id"), F.col("topic")), "review_id")
    return (topics.withColumn("year_month", month)
            .withColumn("_rank", F.row_number().over(worst_first))
            .filter(F.col("_rank") <= per_group)
            .select("app_key", "topic", "year_month", "review_id", "rating", "review_date"))
