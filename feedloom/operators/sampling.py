"""Seeded samples for labelling: stratified, keyword-boosted and spot-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.seeded import seeded_digest, weighted_key
from feedloom.functions.columns import bind
from feedloom.functions.text import labels_matching, matches

PER_STRATUM = 67
SAMPLE_SIZE = 600
DEV_FRACTION = 0.25
PER_TOPIC = 25
CHURN_SIZE = 150
SPOTCHECK_SIZE = 120


def rating_band(rating: Column) -> Column:
    return (F.when(rating.between(1, 2), "negative").when(rating == 3, "neutral")
            .when(rating.between(4, 5), "positive"))


def stratified_sample(reviews: DataFrame, per_stratum: int = PER_STRATUM, size: int = SAMPLE_SIZE,
                      seed: int = 42) -> DataFrame:
    """Equal strata of app and rating band, weighted toward long texts, cut to `size`.

    Weighted sampling without replacement is the `per_stratum` smallest keys
    -ln(u)/w. The limit applies before the shuffle, so a stratum with most of
    the reviews still sends only `per_stratum` rows per map task.
    """
    weight = F.sqrt(F.greatest(F.col("text_length"), F.lit(1)).cast("double"))
    key = weighted_key(seed, weight, F.col("review_id"))
    band = rating_band(F.col("rating"))
    pool = (reviews.select("review_id", "app_key", "rating", "review_text", "text_length")
            .withColumn("rating_band", band).filter(F.col("rating_band").isNotNull())
            .withColumn("stratum", F.concat_ws("_", "app_key", "rating_band"))
            .withColumn("_key", key))
    order = Window.partitionBy("stratum").orderBy("_key", "review_id")
    picked = pool.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_stratum)
    trimmed = picked.orderBy(seeded_digest(seed, F.lit("trim"), F.col("review_id")), "review_id").limit(size)
    return trimmed.drop("_key", "_rank")


def split_dev_test(sample: DataFrame, fraction: float = DEV_FRACTION, seed: int = 42) -> DataFrame:
    """Random split inside each stratum; at least one row goes to dev."""
    by = Window.partitionBy("stratum")
    rank = F.row_number().over(by.orderBy(seeded_digest(seed, F.lit("split"), F.col("review_id")), "review_id"))
    n_dev = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(by) * F.lit(fraction)).cast("int"))
    return sample.withColumn("split", F.when(rank <= n_dev, "dev").otherwise("test"))


def stratum_summary(reviews: DataFrame, sample: DataFrame) -> DataFrame:
    """Pool size, sample size and both median text lengths per stratum."""
    stratum = F.concat_ws("_", "app_key", rating_band(F.col("rating"))).alias("stratum")
    pool = (reviews.groupBy(stratum, "text_length").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("stratum").agg(F.sum("n").alias("pool_size"),
                                    F.percentile("text_length", F.lit(0.5), F.col("n")).alias("pool_median_len")))
    taken = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"),
                                          F.median("text_length").alias("sample_median_len"))
    return pool.join(taken, "stratum")


def shuffled_index(df: DataFrame, key: str, seed: int, name: str = "i") -> DataFrame:
    """Row numbers from 0 in seeded random order, without sorting in one task.

    The leading digits of each row's digest form up to 4,096 buckets in digest
    order. Rows are ranked inside their bucket and shifted by the sizes of the
    earlier buckets.
    """
    marked = df.withColumn("_d", seeded_digest(seed, F.col(key))).withColumn("_b", F.substring("_d", 1, 3))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4,096 rows reach this single ordered window.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))
    return (marked.withColumn("_r", inside).join(offsets, "_b")
            .withColumn(name, F.col("_offset") + F.col("_r") - 1).drop("_d", "_b", "_n", "_offset", "_r"))


# The keyword patterns of rare topics and of leaving language, matched on lower-case text.
RARE_TOPIC_PATTERNS = {
    "ads_spam": r"(too many ads|advertisement|notification.*spam|ads everywhere|pop.?up)",
    "investments_gold": r"(digital gold|digital silver|mutual fund|gold locker|sip\b|gold saving|silver saving)",
    "travel_booking": r"(bus ticket|flight ticket|train ticket|bus operator|irctc|ticket booking|ticket cancel)",
    "autopay_mandates": r"(autopay|auto.?pay|mandate|auto.?debit|recurring payment)",
    "bank_linking": r"(link.*bank account|add.*bank account|bank account.*link|cannot link)",
    "refund_delay": r"(refund.*(not|nahi|delay|pending)|reversal.*(pending|delay))",
    "bills_recharge": r"(recharge (failed|not|plan)|bill payment (failed|not)|electricity bill|dth recharge)",
    "account_blocked": r"(account.*(blocked|suspended|frozen)|blocked.*account)",
    "fees_charges": r"(platform fee|convenience fee|hidden charge|extra charge|service charge)",
}
CHURN_PATTERN = r"(uninstall|switch(ing)? to|switching|never use.*again|done with this app|deleting the app|delete this app|moving to|shifting to)"


def keyword_sample(reviews: DataFrame, used: DataFrame, patterns: dict[str, str], per_topic: int = PER_TOPIC,
                   seed: int = 99) -> DataFrame:
    """Up to `per_topic` unused reviews per keyword pattern; a review keeps its first topic.

    All patterns are tested in one pass. `used` (review_id) is excluded by an
    anti join instead of a literal list.
    """
    names = list(patterns)
    hits = labels_matching(F.lower("review_text"), patterns)
    pool = (reviews.select("review_id", "app_key", "rating", "review_text", "text_length")
            .withColumn("_hits", hits).filter(F.size("_hits") > 0)
            .join(used.select("review_id"), "review_id", "left_anti")
            .withColumn("target_topic", F.explode("_hits")))
    order = Window.partitionBy("target_topic").orderBy(
        seeded_digest(seed, F.col("target_topic"), F.col("review_id")), "review_id")
    drawn = pool.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_topic)
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("target_topic"))
    first = Window.partitionBy("review_id").orderBy(position)
    return (drawn.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1)
            .select("review_id", "app_key", "rating", "review_text", "text_length", "target_topic",
                    F.lit("dev_boost").alias("split")))


def churn_sample(reviews: DataFrame, used: DataFrame, pattern: str, size: int = CHURN_SIZE,
                 seed: int = 123) -> DataFrame:
    """`size` unused reviews with leaving language."""
    pool = (reviews.select("review_id", "app_key", "rating", "review_text", "text_length")
            .filter(bind(F.lower("review_text"), lambda t: matches(t, pattern)))
            .join(used.select("review_id"), "review_id", "left_anti"))
    return (pool.orderBy(seeded_digest(seed, F.col("review_id")), "review_id").limit(size)
            .withColumn("split", F.lit("churn_boost")))


def proportional_sample(labelled: DataFrame, size: int = SPOTCHECK_SIZE, seed: int = 7) -> DataFrame:
    """`size` rows split over apps by their share of the rows (half-even rounding)."""
    totals = labelled.groupBy("app_key").agg(F.count(F.lit(1)).alias("_g"))
    n_all = labelled.agg(F.count(F.lit(1))).scalar()
    quota = totals.select("app_key", F.bround(F.lit(float(size)) * F.col("_g") / n_all).cast("int").alias("_quota"))
    order = Window.partitionBy("app_key").orderBy(seeded_digest(seed, F.col("review_id")), "review_id")
    # No quota exceeds `size`, so the first filter may limit before the shuffle.
    ranked = labelled.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)
    return (ranked.join(quota, "app_key").filter(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota"))


def blind_packet(sample: DataFrame, topics: list[str]) -> DataFrame:
    """The sheet a person fills in: texts with empty label columns."""
    empty = [F.lit("").alias(t) for t in [*topics, "churn_intent", "competitor_mentioned"]]
    return sample.select("review_id", "app_key", "rating", "review_text", *empty)


def answer_key(sample: DataFrame) -> DataFrame:
    return sample.select("review_id", "topics", "churn_intent", "competitor_mentioned")

