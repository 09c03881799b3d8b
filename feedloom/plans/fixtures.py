"""The given tables seen as reviews, topics, flags, events and texts.

Each adapter is a projection (plus at most one dimension join) over a whole
table; `plans/reference_sql.py` states the same adapters in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.sampling import CHURN_PATTERN, RARE_TOPIC_PATTERNS  # noqa: F401

APPS = ["app_a", "app_n", "app_r"]
FOCUS, CONTROLS = "app_a", ["app_n", "app_r"]

TYPE_TOPICS = ["economy", "large", "medium", "promo", "small", "standard"]
NOUN_TOPICS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
GENERIC_TOPICS = ["standard", "widget"]
ISSUE_TOPICS = [t for t in TYPE_TOPICS + NOUN_TOPICS if t not in GENERIC_TOPICS]

DIM_APP_ROWS = [
    ("app_a", "App A", True, "org.example.a", 500_000_000, 4.4, "14.2M"),
    ("app_n", "App N", False, "org.example.n", 1_000_000_000, 4.3, "11.4M"),
    ("app_r", "App R", False, "org.example.r", 500_000_000, 4.7, "24.2M")]
DIM_TOPIC_ROWS = ([(t, t.title(), "Class", t not in GENERIC_TOPICS) for t in TYPE_TOPICS]
                  + [(t, t.title(), "Product", t not in GENERIC_TOPICS) for t in NOUN_TOPICS])

DOWNLOADS = {row[0]: row[4] for row in DIM_APP_ROWS}
TOPIC_F1 = {t: 0.35 + 0.03 * i for i, t in enumerate(ISSUE_TOPICS[:-1])}   # the last topic has no score
EFFORT_WEEKS = {t: 1 + (5 * i) % 8 for i, t in enumerate(ISSUE_TOPICS)}

BRANDS = ["alphapay", "betapay", "gammapay"]
ALIASES = {
    "alphapay": ["alphapay", "alpha pay", "alpha-pay"],
    "betapay": ["betapay", "beta pay"],
    "gammapay": ["gammapay", "gamma pay"],
    "deltapay": ["deltapay", "delta-pay"],
    "zetapay": ["zeta.pay", "zetapay"]}
REMARKS = [
    "switching to alphapay", "came from beta pay", "gammapay is better", "unlike alphapay",
    "alphapay beta pay", "", "i will uninstall and use Delta-Pay",
    "previously used gamma pay, moved to betapay", "zetapay gives more rewards than alphapay",
    "alphapays and xbetapay are not names", "too many ads, refund still pending",
    "never use this again, recharge failed and account blocked"]
MARKERS = ["le", "la", "der", "die", "el", "los"]
TEXT_TOPIC_PATTERNS = RARE_TOPIC_PATTERNS

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag",
                "l_linestatus", "l_shipdate"]

BIN_HOURS = {"app_0": 1, "app_1": 3, "app_2": 3}
INCIDENT_ROWS = [
    ("INC1", "app_0;app_1;app_2", "2024-01-17 19:45", "2024-01-17 20:15", "outage"),
    ("INC2", "app_1", "2024-01-24 06:10", "2024-01-24 12:30", "login")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "review_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scraped reviews; repeated (order, line) keys are re-scrapes."""
    content = (F.when(F.col("l_partkey") % 97 == 0, F.lit("   "))
               .when(F.col("l_partkey") % 89 == 0, F.lit(None).cast("string"))
               .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))))
    release = F.expr("(datediff(cast(l_shipdate as date), date '1995-01-01') - l_partkey % 20 + 60) div 60")
    at = F.expr("timestampadd(HOUR, cast(l_partkey % 24 as int), l_shipdate)")
    return _line_parts(spark, sf_dir).select(
        F.col("review_id").alias("reviewId"),
        content.alias("content"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("score"),
        F.col("l_linenumber").alias("thumbsUpCount"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("v"), release.cast("string")))
        .alias("reviewCreatedVersion"),
        at.alias("at"),
        F.when(F.col("l_linestatus") == "F", F.lit("reply")).alias("replyContent"),
        F.substring(F.sha2(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")), 256), 1, 16).alias("user_hash"),
        F.concat(F.lit("app_"), F.lower("l_returnflag")).alias("app_key"),
        F.expr("timestampadd(DAY, l_linenumber, timestampadd(HOUR, cast(l_partkey % 24 as int), l_shipdate))")
        .alias("scraped_at"))


def raw_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics per line item: the part's class and its noun."""
    pairs = F.array(
        F.struct(F.lower("p_type").alias("topic"), F.lit(0.9).alias("probability")),
        F.struct(F.element_at(F.split("p_name", " "), 2).alias("topic"), (F.col("l_tax") + 0.5).alias("probability")))
    return _line_parts(spark, sf_dir).select("review_id", F.explode(pairs).alias("t")).select("review_id", "t.*")


def raw_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("review_id")
    return line.groupBy(key).agg(
        (F.max("l_discount") >= 0.09).alias("churn_intent"),
        (F.max("l_discount") * 10).alias("churn_probability"))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as time-stamped reviews of three apps."""
    rating = (F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 3)
              .when(F.col("event_type") == "click", 4).otherwise(5))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("review_id"),
        F.concat(F.lit("app_"), (F.col("user_id") % 3).cast("string")).alias("app_key"),
        F.col("ts").alias("reviewed_at"), rating.alias("rating"), F.col("event_type").alias("topic"))


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whole text, every fourth group with a remark appended, as reviews of three brands."""
    pick = F.element_at(F.array(*[F.lit(r) for r in REMARKS]), (F.floor(F.col("doc_id") / 12) % 12 + 1).cast("int"))
    remark = F.when(F.floor(F.col("doc_id") / 3) % 4 == 0, pick).otherwise("")
    brand = F.element_at(F.array(*[F.lit(b) for b in BRANDS]), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat_ws(" ", "text", remark)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), brand.alias("app_key"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"), text.alias("review_text"),
        F.length(text).alias("text_length"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 180).cast("int")).alias("review_date"))


def text_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, source and length class of each document as its topics."""
    size = F.when(F.col("n_chars") >= 1000, "long_text").otherwise("short_text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.explode(F.array(F.col("lang"), F.col("source"), size)).alias("topic"))


def incidents(spark: SparkSession) -> DataFrame:
    from feedloom.sources.files import incident_apps, stage_incidents
    log = spark.createDataFrame(
        INCIDENT_ROWS, "incident_id string, apps_affected string, start_time_ist string, "
        "first_public_report_ist string, type string").withColumn("notes", F.lit(""))
    return incident_apps(stage_incidents(log))
