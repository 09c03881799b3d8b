"""Streaming jobs against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import alerts, staging
from feedloom.streaming import live

SCHEMA = "review_id string, app_key string, rating int, reviewed_at timestamp, scraped_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def reviews(days):
    return [(f"{d}-{h}", "a", 1 + (d + h) % 5, T0 + dt.timedelta(days=d, hours=h), T0 + dt.timedelta(days=d + 1)) for d in days for h in range(24)]


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_bins_and_complete_days_wait_for_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, reviews(range(6)))
    stream = live.read_review_stream(spark, path, SCHEMA)
    days = run(spark, live.complete_days(stream), "days")
    assert sorted(r.review_date.day for r in days.collect()) == [1, 2, 3]
    assert all(r.n_reviews == 24 for r in days.collect())
    bins = run(spark, live.live_bins(live.read_review_stream(spark, path, SCHEMA), 3), "bins3")
    batch = spark.createDataFrame(reviews(range(6)), SCHEMA).groupBy(F.window("reviewed_at", "3 hours").start.alias("b")).agg(
        F.count_if(F.col("rating") <= 2).alias("n"))
    want = {r.b: r.n for r in batch.collect()}
    got = {r.bin_start: r.n_negative for r in bins.collect()}
    assert got and all(want[b] == n for b, n in got.items())


def test_first_copies(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, reviews(range(1)))
    land(spark, path, [(i, a, 5, t, s + dt.timedelta(days=1)) for i, a, _, t, s in reviews(range(1))[:4]])
    first = run(spark, live.first_copies(live.read_review_stream(spark, path, SCHEMA)), "firsts")
    assert first.count() == 24


RAW = ("reviewId string, content string, score int, thumbsUpCount long, reviewCreatedVersion string, at timestamp_ntz, replyContent string, "
       "user_hash string, app_key string, scraped_at timestamp_ntz")


def test_staged_stream_equals_batch_after_late_repeated_and_shuffled_copies(spark, tmp_path):
    """Restarted from its checkpoint for every batch of files; one row per review leaves the state."""
    import random
    r = random.Random(3)
    at = lambda h: T0 + dt.timedelta(hours=h, microseconds=137)
    rows = []
    for i in range(40):
        for copy in range(r.randint(1, 4)):
            rows.append((f"r{i}", r.choice([f" text {copy} ", None, "   ", "né \"quoted\" \n line"]), r.choice([1, 5, None]), r.choice([0, 3, None]), r.choice(["v1", None]),
                         r.choice([at(i), None]), r.choice([None, "reply"]), "u", "app", at(r.randint(0, 20))))
    rows += rows[:25] + [(f"tie{i}", f"text {k}", k, None, None, at(1), None, None, "app", at(3)) for i in range(3) for k in (1, 5, 2)]
    r.shuffle(rows)
    end = [("end", "x", 1, 0, None, at(0), None, "u", "app", at(24 * 30))]
    src, out, ckpt = (str(tmp_path / n) for n in ("raw", "out", "ckpt"))

    def step(part):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(src)
        stream = live.staged_stream(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(src))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
        return stream.schema

    for lo in range(0, len(rows), 40):
        schema = step(rows[lo:lo + 40])
    pending = {x.review_id for x in live.pending_copies(spark, ckpt).collect()}
    assert pending == {x[0] for x in rows}
    step(end)
    step(rows[:10])      # later than the watermark by now: too late
    columns = [f.name for f in schema]
    batch = staging.stage_reviews(spark.createDataFrame(rows, RAW)).select(*columns)
    rows_of = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows_of(spark.read.schema(schema).parquet(out)) == rows_of(batch) and batch.count() > 20


def test_reviews_to_episodes_in_one_query_equal_batch_after_a_restart(spark, tmp_path):
    import random
    r = random.Random(9)
    rows = []
    for day in range(8):
        for hour in range(24):
            n = 6 if (day, hour) in {(1, 3), (1, 6), (1, 18), (4, 0), (4, 1)} else 1
            rows += [(f"{day}-{hour}-{k}", "a", 1, T0 + dt.timedelta(days=day, hours=hour, minutes=r.randint(0, 59)), T0) for k in range(n)]
    base = spark.createDataFrame([("a", h, 1.0, 1.0, 0.0) for h in range(24)],
                                 "app_key string, hour_of_day int, baseline_mean double, baseline_median double, baseline_mad double")
    bins = spark.createDataFrame(rows, SCHEMA).groupBy("app_key", F.window("reviewed_at", "1 hours").alias("w")).agg(F.count_if(F.col("rating") <= 2).alias("n_negative"))
    scored = live.score_bins(bins.select("app_key", F.col("w.start").alias("bin_start"), "n_negative"), base).withColumn("bin_hours", F.lit(1))
    want = sorted((x.app_key, x.start, x.end, x.peak_p) for x in alerts.episodes(scored).collect())
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    order = sorted(rows, key=lambda x: x[3])
    parts = [order[:90], order[90:], [("end", "a", 5, T0 + dt.timedelta(days=40), T0)], [("end2", "a", 5, T0 + dt.timedelta(days=41), T0)]]
    for part in parts:
        r.shuffle(part)
        land(spark, src, part)
        stream = live.live_alert_episodes(live.read_review_stream(spark, src, SCHEMA), 1, base)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((x.app_key, x.start, x.end, x.peak_p) for x in spark.read.parquet(out).collect())
    assert got == want and len(want) == 3


def test_alerts_against_a_baseline_and_session_episodes(spark, tmp_path):
    path = str(tmp_path / "bins")
    starts = [1, 5, 10, 200]
    bins = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), 9) for h in starts], "app_key string, bin_start timestamp, n_negative long")
    base = spark.createDataFrame([("a", h, 1.0, 1.0, 0.0) for h in range(24)],
                                 "app_key string, hour_of_day int, baseline_mean double, baseline_median double, baseline_mad double")
    live.score_bins(bins, base).filter("alert").select("app_key", "bin_start", "poisson_p").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("app_key string, bin_start timestamp, poisson_p double").parquet(path)
    found = run(spark, live.live_episodes(stream, 1), "episodes")
    assert sorted((r.start.hour, r.end.hour) for r in found.collect()) == [(1, 5), (10, 10)]
