"""Streaming forms of the batch jobs: bins, complete days, deduplication, alerts.

All event times are TIMESTAMP columns. The late-data bound is the same two days
the batch marts treat as incomplete.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.functions.stats import poisson_tail
from feedloom.operators.alerts import ALPHA, MERGE_GAP_HOURS, MIN_COUNT, MIN_RATE, Z_THRESHOLD
from feedloom.operators.staging import TIE_BREAK, typed_reviews

LATENESS = "2 days"


def read_review_stream(spark: SparkSession, path: str, schema: str, event_time: str = "reviewed_at",
                       files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a landing folder as a stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp"))


def live_bins(reviews: DataFrame, hours: int, lateness: str = LATENESS) -> DataFrame:
    """Tumbling N-hour counts per app, final once the watermark passes the bin."""
    return (reviews.withWatermark("reviewed_at", lateness)
            .groupBy("app_key", F.window("reviewed_at", f"{hours} hours"))
            .agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("rating") <= 2).alias("n_negative"))
            .select("app_key", F.col("window.start").alias("bin_start"), F.col("window.end").alias("bin_end"),
                    "n_reviews", "n_negative"))


def complete_days(reviews: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Daily metrics that appear, in append mode, only when the day is complete."""
    return (reviews.withWatermark("reviewed_at", lateness)
            .groupBy("app_key", F.window("reviewed_at", "1 day"))
            .agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("rating").alias("avg_rating"),
                 F.avg((F.col("rating") <= 2).cast("double")).alias("negative_share"))
            .select("app_key", F.to_date("window.start").alias("review_date"), "n_reviews", "avg_rating", "negative_share"))


def first_copies(reviews: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop re-scrapes inside the watermark; the first copy of a review stays."""
    return reviews.withWatermark("reviewed_at", lateness).dropDuplicatesWithinWatermark(["review_id"])


class LatestCopy(StatefulProcessor):
    """Keeps the newest copy of each key and gives it out, once, when no newer one can come.

    A copy is newer by its ranks, compared in order, nulls lowest. The timer stands `settle`
    after the newest copy's event time; the state goes with it. An older or repeated copy
    changes nothing. A copy that comes after the timer starts anew.
    """

    def __init__(self, key: str, ranks: list[str], settle_ms: int):
        self.key, self.ranks, self.settle_ms = key, ranks, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [f"{r} {'string' if r.startswith('s_') else 'long'}" for r in self.ranks]
        self.newest = handle.getValueState("newest", ", ".join([*kinds, "payload string"]))

    def order(self, copy) -> tuple:
        return tuple((v is not None, v) for v in copy[:-1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        newest = before
        for row in rows:
            copy = (*(row[r] for r in self.ranks), row["payload"])
            if newest is None or self.order(copy) > self.order(newest):
                newest = copy
        if newest != before:
            self.newest.update(newest)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest[0] // 1000 + self.settle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            payload = self.newest.get()[-1]
            self.newest.clear()
            yield Row(**{self.key: key[0], "payload": payload})

    def close(self) -> None:
        pass


# Copies pass through the state as text; times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def settled_copies(copies: DataFrame, key: str = "review_id", recency: str = "scraped_at", tie_break: tuple[str, ...] = TIE_BREAK,
                   settle_days: int = 2, lateness: str = LATENESS) -> DataFrame:
    """The newest copy per key as the batch staging chooses it, given out `settle_days` after its scrape.

    The output only grows, with one row per key, so readers never look at older copies.
    `settle_days` has to exceed the longest pause between two scrapes of a review. Copies
    without a scrape time, or later than the watermark, are left out.
    """
    columns = [c for c in copies.columns if c != key]

    def rank(name: str) -> Column:
        kind = copies.schema[name].dataType.typeName()
        if kind == "timestamp_ntz":
            return F.unix_micros(F.col(name).cast("timestamp"))
        return F.unix_micros(name) if kind == "timestamp" else F.col(name).cast("string" if kind == "string" else "long")

    given = [recency, *[c for c in tie_break if c in columns]]
    names = [f"{'s' if copies.schema[c].dataType.typeName() == 'string' else 'n'}_{i}" for i, c in enumerate(given)]
    packed = (copies.withColumn("_event", F.col(recency).cast("timestamp")).withWatermark("_event", lateness).where(F.col(recency).isNotNull())
              .select(key, "_event", *[rank(c).alias(n) for c, n in zip(given, names, strict=True)], F.to_json(F.struct(*columns), _JSON).alias("payload")))
    processor = LatestCopy(key, names, settle_days * 24 * 3600 * 1000)
    newest = packed.groupBy(key).transformWithState(processor, f"{key} {copies.schema[key].dataType.simpleString()}, payload string", "Append", "EventTime")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in copies.schema if f.name != key)
    return newest.select(key, F.from_json("payload", fields, _JSON).alias("c")).select(key, "c.*").select(*copies.columns)


def staged_stream(raw: DataFrame, settle_days: int = 2, lateness: str = LATENESS) -> DataFrame:
    """The staged reviews as a stream: typed, newest copies, with text."""
    return settled_copies(typed_reviews(raw), settle_days=settle_days, lateness=lateness).filter(F.col("text_length") > 0)


def pending_copies(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Copies that a (stopped or running) `settled_copies` still holds: key, newest copy as text; read from its state."""
    return spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint).select("key.*", "value.payload")


def score_bins(bins: DataFrame, baseline: DataFrame) -> DataFrame:
    """Live bins against a nightly baseline table (app_key, hour_of_day, mean, median, mad)."""
    hour = F.hour("bin_start")
    joined = bins.withColumn("hour_of_day", hour).join(baseline, ["app_key", "hour_of_day"])
    expected = F.greatest(F.col("baseline_mean"), F.lit(MIN_RATE))
    z = (F.col("n_negative") - F.col("baseline_median")) / (1.4826 * F.col("baseline_mad") + 1.0)
    enough = F.col("n_negative") >= MIN_COUNT
    return (joined.withColumn("poisson_p", poisson_tail(F.col("n_negative"), expected)).withColumn("z", z)
            .withColumn("alert", ((F.col("poisson_p") < ALPHA) | (F.col("z") > Z_THRESHOLD)) & enough))


def live_episodes(alert_bins: DataFrame, bin_hours: int, gap_hours: int = MERGE_GAP_HOURS,
                  lateness: str = LATENESS) -> DataFrame:
    """Session windows over alert bins; starts up to the gap plus one bin apart share an episode."""
    # A session ends a full gap after its last start, so one more second makes the bound inclusive.
    gap = f"{(gap_hours + bin_hours) * 3600 + 1} seconds"
    return (alert_bins.withWatermark("bin_start", lateness)
            .groupBy("app_key", F.session_window("bin_start", gap))
            .agg(F.min("bin_start").alias("start"), F.max("bin_start").alias("end"), F.min("poisson_p").alias("peak_p"))
            .select("app_key", "start", "end", "peak_p"))


def live_alert_episodes(reviews: DataFrame, hours: int, baseline: DataFrame, gap_hours: int = MERGE_GAP_HOURS, lateness: str = LATENESS) -> DataFrame:
    """From reviews to alert episodes in one query: bins, their scores against the baseline, sessions of alerts.

    Both aggregations go by one watermark: a bin leaves when it is complete, an episode when
    no bin can extend it any more. The baseline is read when the query starts, so a restart from the
    checkpoint takes up a new one. Apps of other bin widths have a query of their own.
    """
    bins = (reviews.withWatermark("reviewed_at", lateness)
            .groupBy("app_key", F.window("reviewed_at", f"{hours} hours"))
            .agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("rating") <= 2).alias("n_negative"))
            .select("app_key", F.window_time("window").alias("bin_time"), F.col("window.start").alias("bin_start"), "n_reviews", "n_negative"))
    alerts = score_bins(bins, baseline).filter("alert")
    gap = f"{(gap_hours + hours) * 3600 + 1} seconds"
    return (alerts.groupBy("app_key", F.session_window("bin_time", gap))
            .agg(F.min("bin_start").alias("start"), F.max("bin_start").alias("end"), F.min("poisson_p").alias("peak_p"))
            .select("app_key", "start", "end", "peak_p"))
