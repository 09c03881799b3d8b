"""Exploratory profiles and ad-hoc analyst queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import ratio, share_of, stable_round
from feedloom.functions.text import word_count
from feedloom.session import cut_lineage


def top_weekly_risers(topic_daily: DataFrame, app_daily: DataFrame, top: int = 3) -> DataFrame:
    """Topics whose share rose most in the last week, per app."""
    week = F.to_date(F.date_trunc("week", "review_date"))
    weekly = (topic_daily.filter("is_complete_day").groupBy("app_key", "topic", week.alias("wk"))
              .agg(F.sum("n_topic_reviews").alias("n")))
    weekly = cut_lineage(weekly)    # the last week and the shares read it
    totals = (app_daily.filter("is_complete_day").groupBy("app_key", week.alias("wk"))
              .agg(F.sum("n_reviews").alias("total")))
    series = Window.partitionBy("app_key", "topic").orderBy("wk")
    shares = (weekly.join(totals, ["app_key", "wk"])
              .withColumn("share", ratio(F.col("n"), F.col("total")))
              .withColumn("change", F.col("share") - F.lag("share").over(series)))
    last_week = weekly.agg(F.max("wk")).scalar()
    biggest = Window.partitionBy("app_key").orderBy(F.col("change").desc_nulls_last(), "topic")
    return (shares.filter(F.col("wk") == last_week)
            .withColumn("_rank", F.row_number().over(biggest)).filter(F.col("_rank") <= top)
            .select("app_key", "wk", "topic", stable_round(F.col("share"), 4).alias("share"),
                    stable_round(F.col("change"), 4).alias("wow_change")))


def rating_day_over_day(daily: DataFrame) -> DataFrame:
    series = Window.partitionBy("app_key").orderBy("review_date")
    step = F.col("avg_rating") - F.lag("avg_rating").over(series)
    return daily.filter("is_complete_day").select(
        "app_key", "review_date", "avg_rating", "avg_rating_7d",
        stable_round(step, 3).alias("day_over_day_delta"))


def length_percentiles(reviews: DataFrame) -> DataFrame:
    """Exact median, P90 and P99 of the text length.

    Lengths are counted first, so the exact percentile works on one row per
    app and length instead of one per review.
    """
    counts = reviews.groupBy("app_key", "text_length").agg(F.count(F.lit(1)).alias("n"))

    def at(p: float) -> Column:
        return F.percentile("text_length", F.lit(p), F.col("n"))

    return counts.groupBy("app_key").agg(
        at(0.5).alias("median_len"), at(0.9).alias("p90_len"), at(0.99).alias("p99_len"))


SKETCH_K = 400      # rank error below 0.7 % with a probability of 99 %, see the KLL paper


def length_sketches(reviews: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of the text lengths per app and day: some kilobytes, whatever the number of reviews."""
    return reviews.groupBy("app_key", "review_date").agg(
        F.kll_sketch_agg_bigint(F.col("text_length").cast("bigint"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def sketched_percentiles(sketches: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99), keys: tuple[str, ...] = ("app_key",)) -> DataFrame:
    """Percentiles of any span or group of days from its merged sketches; reviews are not read again."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))
    cells = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("estimate")) for p in points])
    return merged.select(*keys, "n", F.explode(cells).alias("c")).select(*keys, "n", "c.*")


def rank_errors(reviews: DataFrame, estimates: DataFrame, keys: tuple[str, ...] = ("app_key",)) -> DataFrame:
    """Distance of each estimate's true rank range from the rank asked for, as a share of the reviews."""
    counts = reviews.groupBy(*keys, "text_length").agg(F.count(F.lit(1)).alias("m"))
    ranks = estimates.join(counts, list(keys)).groupBy(*keys, "percentile", "estimate", "n").agg(
        F.sum(F.when(F.col("text_length") < F.col("estimate"), F.col("m")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("text_length") <= F.col("estimate"), F.col("m")).otherwise(0)).alias("upto"))
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("percentile"), F.col("percentile") - F.col("upto") / F.col("n"))
    return ranks.select(*keys, "percentile", "estimate", "n", off.alias("rank_error"))


def first_topic_cohort(topics: DataFrame) -> DataFrame:
    """Reviews and mean rating by the first topic of each review and its month."""
    first = topics.groupBy("review_id").agg(
        F.min(F.struct("review_date", "topic", "app_key", "rating")).alias("f")).select("f.*")
    return (first.groupBy("app_key", F.col("topic").alias("first_topic"),
                          F.date_format("review_date", "yyyy-MM").alias("cohort_month"))
            .agg(F.count(F.lit(1)).alias("n_reviewers"),
                 stable_round(F.avg("rating"), 2).alias("avg_rating")))


def topic_cooccurrence(topics: DataFrame, topic: str) -> DataFrame:
    """Topics that share reviews with `topic`.

    Counts per review and topic replace the self join: a pair count is the
    product of two counts, so no pair is ever produced as a row.
    """
    per_review = topics.groupBy("review_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    anchor = F.sum(F.when(F.col("topic") == topic, F.col("n")).otherwise(0)).over(Window.partitionBy("review_id"))
    counts = (per_review.withColumn("n_anchor", anchor).groupBy(F.col("topic").alias("co_occurring_topic"))
              .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n_anchor")).alias("n_co_occurrences")))
    # One row per topic is left here; the anchor's own row holds the denominator.
    total = F.sum(F.when(F.col("co_occurring_topic") == topic, F.col("_n"))).over(Window.partitionBy(F.lit(0)))
    return (counts.withColumn("_total", total)
            .filter((F.col("co_occurring_topic") != topic) & (F.col("n_co_occurrences") > 0))
            .select("co_occurring_topic", "n_co_occurrences",
                    stable_round(100.0 * F.col("n_co_occurrences") / F.col("_total"), 2).alias("pct_of_topic_reviews")))


def impact_leaderboard(impact: DataFrame) -> DataFrame:
    """Releases ranked by the size of their health score (one row per release)."""
    by_size = Window.partitionBy("app_key").orderBy(F.abs("health_score").desc_nulls_last())
    return impact.select(
        "version", "adoption_date", stable_round(F.col("real_effect"), 4).alias("real_effect"),
        stable_round(F.col("health_score"), 2).alias("health_score"),
        stable_round(F.col("q_value"), 3).alias("q_value"), "is_significant", "usable",
        F.rank().over(by_size).alias("rank_by_abs_health_score"))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    counts = reviews.groupBy("app_key", "rating").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("app_key"))
    return counts.select("app_key", "rating", "n", stable_round(100.0 * F.col("n") / total, 1).alias("pct"))


def rating_by_app(distribution: DataFrame, apps: list[str]) -> DataFrame:
    """Rating rows, one percentage column per app."""
    return distribution.groupBy("rating").pivot("app_key", apps).agg(F.first("pct"))


def text_stats(reviews: DataFrame, short_words: int = 5) -> DataFrame:
    """Mean and median length and the share of very short reviews."""
    short = word_count(F.col("review_text")) <= short_words
    counts = reviews.groupBy("app_key", "text_length").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(short).alias("n_short"))
    return counts.groupBy("app_key").agg(
        stable_round(F.sum(F.col("text_length") * F.col("n")) / F.sum("n"), 1).alias("avg_chars"),
        stable_round(F.percentile("text_length", F.lit(0.5), F.col("n")), 1).alias("median_chars"),
        stable_round(100.0 * F.sum("n_short") / F.sum("n"), 1).alias("pct_short"))


def word_histogram(reviews: DataFrame, max_words: int = 40) -> DataFrame:
    """Reviews per app and word count; the bin `max_words` + 1 holds all longer ones."""
    words = F.least(word_count(F.col("review_text")), F.lit(max_words + 1)).alias("n_words")
    return reviews.select("app_key", words).groupBy("app_key", "n_words").agg(F.count(F.lit(1)).alias("n"))


def missing_version(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("app_key").agg(
        stable_round(100.0 * share_of(F.col("review_version").isNull()), 1).alias("pct_missing_version"))


def hour_profile(reviews: DataFrame) -> DataFrame:
    """Share of each app's reviews per hour of day, all 24 hours present."""
    counts = reviews.groupBy("app_key", F.hour("reviewed_at").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("app_key").distinct().select(
        "app_key", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hr"))
    filled = grid.join(counts, ["app_key", "hr"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("app_key"))
    return filled.select("app_key", "hr", "n", (100.0 * F.col("n") / total).alias("pct"))


def reply_profile(reviews: DataFrame) -> DataFrame:
    replied = F.col("has_dev_reply")
    return reviews.groupBy("app_key").agg(
        stable_round(100.0 * share_of(replied), 2).alias("pct_replied"),
        stable_round(F.avg(F.when(replied, F.col("rating"))), 2).alias("avg_rating_replied"),
        stable_round(F.avg(F.when(~replied, F.col("rating"))), 2).alias("avg_rating_not_replied"))


def missing_days(reviews: DataFrame) -> DataFrame:
    """Calendar days inside each app's span that have no review."""
    seen = reviews.groupBy("app_key", "review_date").agg(F.count(F.lit(1)).alias("n"))
    span = seen.groupBy("app_key").agg(F.min("review_date").alias("lo"), F.max("review_date").alias("hi"))
    calendar = span.select("app_key", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("review_date"))
    return calendar.join(seen, ["app_key", "review_date"], "left_anti")


def coverage_audit(reviews: DataFrame) -> DataFrame:
    """First and last day, days in the span and missing days per app."""
    seen = reviews.select("app_key", "review_date").distinct()
    agg = seen.groupBy("app_key").agg(F.min("review_date").alias("first_day"), F.max("review_date").alias("last_day"),
                                      F.count(F.lit(1)).alias("n_seen"))
    span = F.datediff("last_day", "first_day") + 1
    return agg.select("app_key", "first_day", "last_day", span.alias("n_days"),
                      (span - F.col("n_seen")).alias("n_missing"))


def topic_prevalence(topics: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs per topic and as percentage of all reviews."""
    total = reviews.agg(F.count(F.lit(1))).scalar()
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", stable_round(100.0 * F.col("n") / total, 1))


def topic_coverage(topics: DataFrame) -> DataFrame:
    """How many review-topic pairs there are and how many reviews carry one."""
    return topics.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("review_id").alias("n_reviews"))


def marker_share(reviews: DataFrame, markers: list[str]) -> DataFrame:
    """Share of reviews with one of the marker words of a mixed-in language."""
    pattern = "(?<![A-Za-z0-9_])(" + "|".join(markers) + ")(?![A-Za-z0-9_])"
    hit = F.lower("review_text").rlike(pattern)
    return reviews.groupBy("app_key").agg(stable_round(100.0 * share_of(hit), 1).alias("pct_with_marker"))


def spike_days(daily: DataFrame, min_share: float = 0.30, min_reviews: int = 20, limit: int = 15) -> DataFrame:
    """The `limit` complete days with the highest negative share."""
    return (daily.filter((F.col("negative_share") > min_share) & (F.col("n_reviews") >= min_reviews)
                         & F.col("is_complete_day"))
            .orderBy(F.col("negative_share").desc(), "app_key", "review_date").limit(limit)
            .select("app_key", "review_date", "negative_share", "n_reviews"))


def mean_negative_share(daily: DataFrame) -> DataFrame:
    """Unweighted mean over complete days: the reference line of the spike chart."""
    return daily.filter("is_complete_day").groupBy("app_key").agg(
        F.avg("negative_share").alias("mean_negative_share"))

