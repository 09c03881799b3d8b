"""Early warning: hourly bins, same-hour baselines, alerts, episodes, incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import floor_to_bin, hours_between, literal_map, ratio
from feedloom.functions.stats import poisson_tail, sorted_median
from feedloom.session import cut_lineage

BASELINE_DAYS = 14
MIN_HISTORY = 5
MIN_RATE = 0.5
ALPHA = 0.01
MIN_COUNT = 3
Z_THRESHOLD = 3.0
MERGE_GAP_HOURS = 3


def bin_width(app: Column, bin_hours: dict[str, int], default: int = 3) -> Column:
    return F.coalesce(literal_map(bin_hours)[app], F.lit(default))


def review_bins(reviews: DataFrame, bin_hours: dict[str, int], default: int = 3) -> DataFrame:
    """Reviews and negative reviews per app and N-hour bin, empty bins included.

    One row per app and bin leaves the aggregation, however many reviews an app
    has; the calendar is built from those rows.
    """
    width = bin_width(F.col("app_key"), bin_hours, default)
    counted = (reviews.select("app_key", width.alias("bin_hours"),
                              floor_to_bin(F.col("reviewed_at"), width).alias("bin_start"), "rating")
               .groupBy("app_key", "bin_hours", "bin_start")
               .agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("rating") <= 2).alias("n_negative")))
    return fill_bins(counted, ["app_key", "bin_hours"], ["n_reviews", "n_negative"])


def fill_bins(counted: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Complete each key's bin sequence from its first to its last bin with zeros.

    Every counted bin also gives the empty ones up to the next, so the counts are read once.
    """
    following = F.lead("bin_start").over(Window.partitionBy(*keys).orderBy("bin_start"))
    width = F.make_interval(hours=F.col("bin_hours"))
    until = F.coalesce(following - width, F.col("bin_start"))
    steps = counted.withColumn("_until", until).withColumn("_bin", F.explode(F.sequence(F.col("bin_start"), F.col("_until"), width)))
    own = F.col("_bin") == F.col("bin_start")
    return (steps.withColumns({c: F.when(own, F.col(c)).otherwise(F.lit(0)) for c in counts})
            .select(*keys, F.col("_bin").alias("bin_start"), *[c for c in counted.columns if c not in (*keys, "bin_start")])
            .withColumn("hour_of_day", F.hour("bin_start")))


def with_baseline(bins: DataFrame, bin_hours: dict[str, int], default: int = 3,
                  baseline_days: int = BASELINE_DAYS, count: str = "n_negative",
                  season: tuple[str, ...] = ("hour_of_day",)) -> DataFrame:
    """Mean, median and median absolute deviation of earlier bins of the same season.

    The lookback counts rows inside one season group. A frame holds at most the
    widest lookback, so its array stays small; apps with wider bins use its tail.
    """
    def lookback(hours: int) -> int:
        return int(baseline_days * 24 / hours)

    widest = max(lookback(h) for h in [*bin_hours.values(), default])
    own = F.least((F.lit(baseline_days * 24) / F.col("bin_hours")).cast("int"), F.size("_seen"))
    history = Window.partitionBy("app_key", *season).orderBy("bin_start").rowsBetween(-widest, -1)

    seen = bins.withColumn("_seen", F.collect_list(F.col(count).cast("double")).over(history))
    tail = seen.withColumn("_tail", F.array_sort(F.when(own > 0, F.slice("_seen", -own, own)).otherwise(F.col("_seen"))))
    enough = F.size("_tail") >= MIN_HISTORY
    median = tail.withColumn("baseline_median", F.when(enough, sorted_median(F.col("_tail"))))
    gaps = F.array_sort(F.transform("_tail", lambda x: F.abs(x - F.col("baseline_median"))))
    total = F.aggregate("_tail", F.lit(0.0), lambda acc, x: acc + x)
    return (median
            .withColumn("baseline_mean", F.when(enough, total / F.size("_tail")))
            .withColumn("_gaps", gaps)
            .withColumn("baseline_mad", F.when(enough, sorted_median(F.col("_gaps"))))
            .drop("_seen", "_tail", "_gaps"))


def detect(bins: DataFrame, alpha: float | Column = ALPHA, min_count: int | Column = MIN_COUNT,
           z_threshold: float | Column = Z_THRESHOLD, count: str = "n_negative") -> DataFrame:
    """Poisson and robust-z alerts on bins with a baseline."""
    n = F.col(count)
    expected = F.when(F.col("baseline_mean").isNotNull(), F.greatest(F.col("baseline_mean"), F.lit(MIN_RATE)))
    return flag_alerts(
        bins.withColumn("expected", expected)
        .withColumn("poisson_p", F.when(F.col("expected").isNotNull(), poisson_tail(n, F.col("expected"))))
        .withColumn("z", (n - F.col("baseline_median")) / (1.4826 * F.col("baseline_mad") + 1.0)),
        alpha, min_count, z_threshold, count)


def flag_alerts(scored: DataFrame, alpha: float | Column = ALPHA, min_count: int | Column = MIN_COUNT,
                z_threshold: float | Column = Z_THRESHOLD, count: str = "n_negative") -> DataFrame:
    """Apply thresholds to bins that already carry `poisson_p` and `z`."""
    def value(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    enough = F.col(count) >= value(min_count)
    return (scored
            .withColumn("alert_poisson", F.coalesce((F.col("poisson_p") < value(alpha)) & enough, F.lit(False)))
            .withColumn("alert_zscore", F.coalesce((F.col("z") > value(z_threshold)) & enough, F.lit(False)))
            .withColumn("alert", F.col("alert_poisson") | F.col("alert_zscore")))


def scored_bins(reviews: DataFrame, bin_hours: dict[str, int], default: int = 3) -> DataFrame:
    """Bins, baselines and detectors in one call."""
    return detect(with_baseline(review_bins(reviews, bin_hours, default), bin_hours, default))


def episodes(bins: DataFrame, gap_hours: int = MERGE_GAP_HOURS, keys: tuple[str, ...] = ("app_key",)) -> DataFrame:
    """Alert bins merged while starts lie within the gap plus one bin width."""
    series = Window.partitionBy(*keys).orderBy("bin_start")
    pause = hours_between(F.lag("bin_start").over(series), F.col("bin_start"))
    opens = F.coalesce((pause > gap_hours + F.col("bin_hours")).cast("int"), F.lit(1))
    alerts = bins.filter("alert").withColumn("_opens", opens)
    numbered = alerts.withColumn("_episode", F.sum("_opens").over(
        series.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (numbered.groupBy(*keys, "_episode")
            .agg(F.min("bin_start").alias("start"), F.max("bin_start").alias("end"), F.min("poisson_p").alias("peak_p"))
            .drop("_episode"))


def alert_rate(bins: DataFrame, found: DataFrame) -> DataFrame:
    """Episodes per week of each app's span (whole days)."""
    days = F.floor(hours_between(F.min("bin_start"), F.max("bin_start")) / 24.0)
    span = bins.groupBy("app_key", "bin_hours").agg((days / 7.0).alias("n_weeks"))
    counts = found.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_events"))
    return (span.join(counts, "app_key", "left").fillna(0, ["n_events"])
            .withColumn("events_per_week", ratio(F.col("n_events"), F.col("n_weeks"))))


def match_incidents(bins: DataFrame, incidents: DataFrame, bin_hours: dict[str, int], default: int = 3) -> DataFrame:
    """Did the bin that holds an incident's start alert, and how early?

    Flooring the incident time to its app's bin turns the interval test into an
    equality join. Lead time counts from the bin's close, when a batch job can
    first see it.
    """
    keyed = incidents.withColumn(
        "bin_start", floor_to_bin(F.col("start_time_ist"), bin_width(F.col("app_key"), bin_hours, default)))
    hit = keyed.join(bins, ["app_key", "bin_start"])
    close = F.expr("timestampadd(HOUR, bin_hours, bin_start)")
    lead = F.when(F.col("alert"), hours_between(F.col("bin_close"), F.col("first_public_report_ist")))
    verdict = (F.when(~F.col("alert"), "not matched").when(F.col("lead_time_hours") > 0, "beat the report")
               .otherwise("lagged the report"))
    return (hit.withColumn("bin_close", close).withColumn("lead_time_hours", lead).withColumn("verdict", verdict)
            .select("incident_id", "app_key", "bin_start", "bin_close", "n_reviews", "n_negative",
                    "expected", "poisson_p", "z", "alert", "lead_time_hours", "verdict"))


def bins_near_incidents(bins: DataFrame, incidents: DataFrame, hours: int,
                        bin_hours: dict[str, int], default: int = 3) -> DataFrame:
    """Bins that start within `hours` of an incident's start.

    Each incident lists the bin starts in its range, so this too is an equality join.
    """
    width = bin_width(F.col("app_key"), bin_hours, default)
    start = F.col("start_time_ist")
    first = F.expr(f"timestampadd(HOUR, -{hours}, start_time_ist)")
    last = F.expr(f"timestampadd(HOUR, {hours}, start_time_ist)")
    steps = F.sequence(floor_to_bin(first, width), floor_to_bin(last, width), F.make_interval(hours=width))
    wanted = (incidents.select("incident_id", "app_key", start, first.alias("_lo"), F.explode(steps).alias("bin_start"))
              .filter(F.col("bin_start") >= F.col("_lo")))
    return (wanted.join(bins, ["app_key", "bin_start"])
            .withColumn("hours_from_start", hours_between(F.col("start_time_ist"), F.col("bin_start")))
            .select("incident_id", "app_key", "bin_start", "hours_from_start", "n_reviews", "n_negative",
                    "expected", "poisson_p", "z", "alert"))


def overlapping_episodes(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Episodes that overlap a candidate window (app_key, lo, hi) of the same app."""
    def days(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.to_date(lo), F.greatest(F.to_date(hi), F.to_date(lo)))).alias("_day")

    # The first day that both cover names a pair once.
    left, right = found.select("*", days("start", "end")), windows.select("*", days("lo", "hi"))
    return (left.join(right, ["app_key", "_day"])
            .filter((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo"))
                    & (F.col("_day") == F.greatest(F.to_date("start"), F.to_date("lo")))).drop("_day"))


# ------------------------------------------------------- planned variants

def topic_share_bins(reviews: DataFrame, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """Hourly topic counts against the topic's share in the preceding days.

    `reviews` carries one topic per row. The baseline is a time range that ends
    before the current hour.
    """
    hour = floor_to_bin(F.col("reviewed_at"), F.lit(1)).alias("bin_start")
    seen = reviews.groupBy("app_key", hour, "topic").agg(F.count(F.lit(1)).alias("topic_reviews"))
    # Every hour of an app counts for each of its topics, also hours without the topic.
    topics = seen.groupBy("app_key").agg(F.collect_set("topic").alias("_topics"))
    hours = seen.groupBy("app_key", "bin_start").agg(F.map_from_entries(F.collect_list(F.struct("topic", "topic_reviews"))).alias("_n"))
    counts = (hours.join(topics, "app_key").withColumn("topic", F.explode("_topics"))
              .select("app_key", "bin_start", "topic", F.coalesce(F.col("_n")[F.col("topic")], F.lit(0)).alias("topic_reviews")))
    total = F.sum("topic_reviews").over(Window.partitionBy("app_key", "bin_start"))
    second = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("bin_start"))
    earlier = (Window.partitionBy("app_key", "topic").orderBy("_sec")
               .rangeBetween(-baseline_days * 86400, -1))
    share = ratio(F.sum("topic_reviews").over(earlier), F.sum("total_reviews").over(earlier))
    scored = (counts.withColumn("total_reviews", total).withColumn("_sec", second)
              .withColumn("baseline_share", share).drop("_sec")
              .withColumn("expected", F.when(F.col("baseline_share").isNotNull(), F.greatest(
                  F.col("total_reviews") * F.col("baseline_share"), F.lit(MIN_RATE)))))
    p = F.when(F.col("expected").isNotNull(), poisson_tail(F.col("topic_reviews"), F.col("expected")))
    return (scored.withColumn("poisson_p", p)
            .withColumn("alert", F.coalesce((F.col("poisson_p") < ALPHA) & (F.col("topic_reviews") >= MIN_COUNT), F.lit(False))))


def hour_of_week_bins(reviews: DataFrame, bin_hours: dict[str, int], default: int = 3,
                      weeks: int = 4) -> DataFrame:
    """Robust-z detector against the same hour of the week."""
    bins = review_bins(reviews, bin_hours, default).withColumn("day_of_week", F.dayofweek("bin_start") - 1)
    # One row per week and season: `weeks` of history are `weeks` rows.
    history = Window.partitionBy("app_key", "day_of_week", "hour_of_day").orderBy("bin_start").rowsBetween(-weeks, -1)
    seen = bins.withColumn("_seen", F.array_sort(F.collect_list(F.col("n_negative").cast("double")).over(history)))
    full = F.size("_seen") >= 2
    scored = (seen.withColumn("baseline_median", F.when(full, sorted_median(F.col("_seen"))))
              .withColumn("_gaps", F.array_sort(F.transform("_seen", lambda x: F.abs(x - F.col("baseline_median")))))
              .withColumn("baseline_mad", F.when(full, sorted_median(F.col("_gaps"))))
              .withColumn("z", (F.col("n_negative") - F.col("baseline_median")) / (1.4826 * F.col("baseline_mad") + 1.0)))
    return (scored.drop("_seen", "_gaps")
            .withColumn("alert", F.coalesce(F.col("z") > Z_THRESHOLD, F.lit(False))))


def near_incidents(found: DataFrame, incidents: DataFrame, before_hours: int, after_hours: int) -> DataFrame:
    """Episodes beside the incidents of their app and day; `inside` where one starts within the hours around an incident."""
    watch = incidents.select(
        "incident_id", "app_key", "first_public_report_ist",
        F.expr(f"timestampadd(HOUR, -{before_hours}, start_time_ist)").alias("lo"),
        F.expr(f"timestampadd(HOUR, {after_hours}, start_time_ist)").alias("hi"))
    watch = watch.select("*", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("_day"))
    paired = found.withColumn("_day", F.to_date("start")).join(watch, ["app_key", "_day"], "left")
    return paired.withColumn("inside", F.coalesce((F.col("start") >= F.col("lo")) & (F.col("start") <= F.col("hi")), F.lit(False)))


def scorecard(found: DataFrame, incidents: DataFrame, before_hours: int = 2, after_hours: int = 12,
              keys: tuple[str, ...] = ()) -> DataFrame:
    """Event recall, alert precision and median lead time of episodes against incidents.

    An incident counts as caught when an episode starts between `before_hours`
    before and `after_hours` after it, in one of its apps. Extra `keys` (for
    example a threshold setting) give one scorecard per key.
    """
    paired = near_incidents(found, incidents, before_hours, after_hours)
    inside = F.col("inside")
    per_episode = paired.groupBy(*keys, "app_key", "start").agg(F.max(inside).alias("matched"))
    caught = (paired.filter(inside).groupBy(*keys, "incident_id")
              .agg(F.max(hours_between(F.col("start"), F.col("first_public_report_ist"))).alias("lead")))
    alerts = per_episode.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.count_if("matched").alias("n_matched"))
    hits = caught.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_caught"), F.median("lead").alias("median_lead_hours"))
    n_incidents = incidents.agg(F.countDistinct("incident_id")).scalar()
    if keys:
        joined = alerts.join(hits, list(keys), "left")
    else:   # one row each: stacked and folded, without a join
        both = alerts.unionByName(hits, allowMissingColumns=True)
        joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return (joined.fillna(0, ["n_caught"]).withColumn("n_incidents", n_incidents)
            .withColumn("event_recall", ratio(F.col("n_caught"), F.col("n_incidents")))
            .withColumn("alert_precision", ratio(F.col("n_matched"), F.col("n_episodes"))))


def threshold_sweep(scored: DataFrame, settings: list[tuple[float, int, float]]) -> DataFrame:
    """Episodes under every (alpha, min_count, z) setting, keyed by the setting."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(int(m)).alias("min_count"),
                              F.lit(float(z)).alias("z_threshold")) for a, m, z in settings])
    spread = scored.withColumn("_s", F.explode(grid)).select("*", "_s.*").drop("_s")
    flagged = flag_alerts(spread, F.col("alpha"), F.col("min_count"), F.col("z_threshold"))
    return episodes(flagged, keys=("alpha", "min_count", "z_threshold", "app_key"))


SETTING = ("alpha", "min_count", "z_threshold")


def operating_curve(scored: DataFrame, incidents: DataFrame, settings: list[tuple[float, int, float]], most_false: float = 1.0,
                    before_hours: int = 2, after_hours: int = 12) -> DataFrame:
    """Recall against false alerts per app and week for every detector setting, and the setting to use.

    A setting is allowed if its unmatched episodes stay within `most_false` per app and week. Of
    the allowed ones (else of all) the highest recall is chosen, then the fewest false alerts,
    then the strictest thresholds. With few incidents the choice is tried by leaving each one
    out: `n_chosen_without` counts the incidents without which this setting would have been
    chosen, `n_held_out_caught` those of them that it then catches. The scored bins are read
    once for all settings, and once for the span of each app.
    """
    keys = list(SETTING)
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(int(m)).alias("min_count"), F.lit(float(z)).alias("z_threshold")) for a, m, z in settings])
    paired = cut_lineage(near_incidents(threshold_sweep(scored, settings), incidents, before_hours, after_hours)
                         .groupBy(*keys, "app_key", "start", F.when(F.col("inside"), F.col("incident_id")).alias("incident_id")).agg(F.max("inside").alias("inside")))
    per_episode = paired.groupBy(*keys, "app_key", "start").agg(F.max("inside").alias("matched"))
    episodes_of = per_episode.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"), F.count_if(~F.col("matched")).alias("n_false"))
    caught = paired.filter("inside").select(*keys, "incident_id").distinct()
    days = F.floor(hours_between(F.min("bin_start"), F.max("bin_start")) / 24.0)
    weeks = scored.groupBy("app_key").agg((days / 7.0).alias("w")).agg(F.sum("w")).scalar()
    names = incidents.select("incident_id").distinct()
    total = names.agg(F.count(F.lit(1))).scalar()
    # one row per incident and setting, both few
    cells = (names.select("incident_id", F.explode(grid).alias("s")).select("incident_id", "s.*")
             .join(caught.withColumn("hit", F.lit(1)), [*keys, "incident_id"], "left").fillna(0, ["hit"])
             .join(episodes_of, keys, "left").fillna(0, ["n_episodes", "n_false"]))
    setting = Window.partitionBy(*keys)
    cells = (cells.withColumn("n_caught", F.sum("hit").over(setting)).withColumn("n_incidents", total)
             .withColumn("false_per_app_week", ratio(F.col("n_false"), weeks)))

    def rank(hits: Column) -> Column:
        allowed = F.coalesce(F.col("false_per_app_week") <= most_false, F.lit(False))
        return F.struct((~allowed).alias("a"), F.when(allowed, -hits).otherwise(0).alias("b"), F.col("n_false").alias("c"), (-hits).alias("d"),
                        F.col("alpha").alias("e"), (-F.col("min_count")).alias("f"), (-F.col("z_threshold")).alias("g"))

    all_rank, own_rank = rank(F.col("n_caught")), rank(F.col("n_caught") - F.col("hit"))
    best = F.row_number().over(Window.partitionBy("incident_id").orderBy(own_rank)) == 1
    first = F.row_number().over(Window.partitionBy("incident_id").orderBy(all_rank)) == 1
    return (cells.withColumn("_left_out", best).withColumn("_first", first)
            .groupBy(*keys, "n_episodes", "n_false", "n_caught", "n_incidents", "false_per_app_week")
            .agg(F.max("_first").alias("chosen"), F.count_if("_left_out").alias("n_chosen_without"), F.count_if(F.col("_left_out") & (F.col("hit") == 1)).alias("n_held_out_caught"))
            .withColumn("recall", ratio(F.col("n_caught"), F.col("n_incidents"))))
