"""Release impact: difference-in-differences, placebo tests, rollout overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import ratio
from feedloom.functions.seeded import seeded_digest
from feedloom.functions.stats import student_t_p

WINDOW = 21
BUFFER = (1, 2)
MIN_WINDOW_DAYS = 7
MIN_PLACEBOS = 20
MAX_PLACEBOS = 150
Q_THRESHOLD = 0.10
SEED = 2026


def window_offsets(window: int = WINDOW, buffer: tuple[int, int] = BUFFER) -> list[int]:
    """Day offsets before and after an event, without the rollout days between."""
    return list(range(-window, -buffer[0] + 1)) + list(range(buffer[1], window + 1))


def event_days(events: DataFrame, date: str, offsets: list[int]) -> DataFrame:
    """One row per event and day of its window, ready for an equality join on the day."""
    return (events.withColumn("_offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
            .withColumn("review_date", F.date_add(F.col(date), F.col("_offset")))
            .withColumn("post", F.col("_offset") > 0))


def panel_by_day(daily: DataFrame, apps: list[str]) -> DataFrame:
    """Complete days as one row per day with each app's outcome and weight."""
    cells = []
    for i, app in enumerate(apps):
        own = F.col("app_key") == app
        cells += [F.max(F.when(own, F.col("negative_share"))).alias(f"y{i}"),
                  F.max(F.when(own, F.col("n_reviews").cast("double"))).alias(f"w{i}")]
    return daily.filter("is_complete_day").filter(F.col("app_key").isin(*apps)).groupBy("review_date").agg(*cells)


def did_effects(daily: DataFrame, dates: DataFrame, focus: str, controls: list[str],
                window: int = WINDOW, buffer: tuple[int, int] = BUFFER) -> DataFrame:
    """Weighted two-way fixed-effects effect of each event date on the negative share.

    Model: share ~ treated:post + app + day, weighted by volume. Day effects go
    by centring inside each day row (all apps of a day share a row), so an
    event needs only sums of products over its days: one join on the day and
    one aggregation for all events together. App dummies are then eliminated
    from the summed normal equations. No effect (null) when the focus app has
    fewer than three days on a side, a side has no control, or the term is not
    identified.
    """
    apps = [focus, *controls]
    days = event_days(dates.select("event_date").distinct(), "event_date", window_offsets(window, buffer))
    rows = days.join(panel_by_day(daily, apps), "review_date")

    present = [F.col(f"w{i}").isNotNull() for i in range(len(apps))]
    w = [F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(len(apps))]
    y = [F.coalesce(F.col(f"y{i}"), F.lit(0.0)) for i in range(len(apps))]
    post = F.col("post").cast("double")
    total = sum(w[1:], w[0])

    # Regressors: 0 is treated:post, 1.. are the control-app dummies. Each is
    # non-zero for a single app, so a weighted product needs no sum over apps.
    scale = [post] + [F.lit(1.0)] * len(controls)
    mass = [scale[j] * w[j] for j in range(len(apps))]
    outcome = sum((a * b for a, b in zip(w[1:], y[1:])), w[0] * y[0])

    sums = []
    for i in range(len(apps)):
        for j in range(i, len(apps)):
            own = mass[i] * scale[j] if i == j else F.lit(0.0)
            sums.append(F.sum(own - mass[i] * mass[j] / total).alias(f"g{i}_{j}"))
        sums.append(F.sum(mass[i] * y[i] - mass[i] * outcome / total).alias(f"b{i}"))
    has_control = present[1]
    for p in present[2:]:
        has_control = has_control | p
    guards = [
        F.count_if(present[0] & ~F.col("post")).alias("n_pre"),
        F.count_if(present[0] & F.col("post")).alias("n_post"),
        F.count_if(has_control & ~F.col("post")).alias("n_control_pre"),
        F.count_if(has_control & F.col("post")).alias("n_control_post"),
        F.sum(mass[0]).alias("treated_mass")]
    solved = rows.groupBy("event_date").agg(*sums, *guards)

    for pivot in range(len(apps) - 1, 0, -1):
        diagonal = F.col(f"g{pivot}_{pivot}")
        usable = diagonal > 1e-9
        updates = {}
        for i in range(pivot):
            factor = F.when(usable, F.col(f"g{i}_{pivot}") / diagonal).otherwise(F.lit(0.0))
            for j in range(i, pivot):
                updates[f"g{i}_{j}"] = F.col(f"g{i}_{j}") - factor * F.col(f"g{j}_{pivot}")
            updates[f"b{i}"] = F.col(f"b{i}") - factor * F.col(f"b{pivot}")
        solved = solved.withColumns(updates)

    valid = ((F.col("n_pre") >= 3) & (F.col("n_post") >= 3) & (F.col("n_control_pre") > 0)
             & (F.col("n_control_post") > 0) & (F.col("g0_0") > 1e-9 * F.col("treated_mass")))
    return solved.select("event_date", F.when(valid, F.col("b0") / F.col("g0_0")).alias("effect"))


def focus_range(daily: DataFrame, focus: str) -> DataFrame:
    """First and last complete day of the focus app."""
    return daily.filter((F.col("app_key") == focus) & F.col("is_complete_day")).groupBy("app_key").agg(
        F.min("review_date").alias("min_d"), F.max("review_date").alias("max_d"))


def release_windows(daily: DataFrame, adoption: DataFrame, focus: str, window: int = WINDOW,
                    buffer: tuple[int, int] = BUFFER, min_days: int = MIN_WINDOW_DAYS) -> DataFrame:
    """Focus-app releases with the days its own history offers on each side."""
    d, lo, hi = F.col("adoption_date"), F.col("min_d"), F.col("max_d")
    pre = F.datediff(F.least(F.date_sub(d, buffer[0]), hi), F.greatest(F.date_sub(d, window), lo)) + 1
    post = F.datediff(F.least(F.date_add(d, window), hi), F.greatest(F.date_add(d, buffer[1]), lo)) + 1
    releases = adoption.filter(F.col("app_key") == focus).select(
        "app_key", F.col("review_version").alias("version"), "adoption_date")
    return (releases.join(focus_range(daily, focus), "app_key")
            .withColumn("n_pre_days", F.greatest(pre, F.lit(0)))
            .withColumn("n_post_days", F.greatest(post, F.lit(0)))
            .withColumn("testable", (pre >= min_days) & (post >= min_days)))


def placebo_dates(windows: DataFrame, window: int = WINDOW, max_placebos: int = MAX_PLACEBOS,
                  seed: int = SEED) -> DataFrame:
    """Seeded draw of event dates with full windows that avoid the release itself."""
    pool = (windows.filter("testable")
            .filter(F.date_add("min_d", window) <= F.date_sub("max_d", window))
            .withColumn("event_date", F.explode(F.sequence(F.date_add("min_d", window), F.date_sub("max_d", window))))
            .filter(F.abs(F.datediff("event_date", "adoption_date")) > window))
    order = Window.partitionBy("version").orderBy(
        seeded_digest(seed, F.col("version"), F.col("event_date")), "event_date")
    return (pool.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_placebos)
            .select("app_key", "version", "event_date"))


def placebo_effects(effects: DataFrame, placebos: DataFrame) -> DataFrame:
    """Effects of the drawn dates; many releases share dates, each was fitted once."""
    return placebos.join(effects.filter(F.col("effect").isNotNull()), "event_date")


def candidate_dates(windows: DataFrame, placebos: DataFrame) -> DataFrame:
    """Every date the release test needs an effect for."""
    real = windows.filter("testable").select(F.col("adoption_date").alias("event_date"))
    return real.unionByName(placebos.select("event_date")).distinct()


def benjamini_hochberg(tests: DataFrame, p: str, key: str, family: str) -> DataFrame:
    """Adds `q_value` within each family; rows without a p-value keep null."""
    scored = F.col(p).isNotNull()
    fam = Window.partitionBy(family, scored)
    rank = F.row_number().over(fam.orderBy(F.col(p), F.col(key)))
    ranked = tests.withColumn("_rank", rank).withColumn("_m", F.count(F.lit(1)).over(fam))
    from_largest = fam.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(from_largest))
    return ranked.withColumn("q_value", F.when(scored, q)).drop("_rank", "_m")


def release_impact(windows: DataFrame, effects: DataFrame, placebo: DataFrame,
                   q_threshold: float = Q_THRESHOLD, min_placebos: int = MIN_PLACEBOS) -> DataFrame:
    """One row per release: effect, placebo p-value, health score, q-value."""
    real = windows.join(effects.withColumnRenamed("event_date", "adoption_date"), "adoption_date", "left").select(
        "app_key", "version", "adoption_date", "n_pre_days", "n_post_days",
        F.when(F.col("testable"), F.col("effect")).alias("real_effect"))
    null = (placebo.join(real.select("version", "real_effect"), "version")
            .groupBy("version").agg(
                F.count(F.lit(1)).alias("_n"),
                F.count_if(F.abs("effect") >= F.abs("real_effect")).alias("_extreme"),
                F.stddev_pop("effect").alias("_sd")))
    has_effect = F.col("real_effect").isNotNull()
    usable = has_effect & (F.col("_n") >= min_placebos)
    tested = (real.join(null, "version", "left").fillna(0, ["_n"])
              .withColumn("usable", usable)
              .withColumn("n_placebo", F.when(has_effect, F.col("_n")).otherwise(F.lit(0)))
              .withColumn("placebo_p", F.when(usable, (F.col("_extreme") + 1.0) / (F.col("_n") + 1.0)))
              .withColumn("health_score", F.when(usable & (F.col("_sd") > 0), F.col("real_effect") / F.col("_sd"))))
    return (benjamini_hochberg(tested, "placebo_p", "version", "app_key")
            .withColumn("is_significant", F.coalesce(F.col("q_value") <= q_threshold, F.lit(False)))
            .select("app_key", "version", "adoption_date", "n_pre_days", "n_post_days", "usable", "real_effect",
                    "n_placebo", "placebo_p", "q_value", "health_score", "is_significant"))


def placebo_histogram(placebo: DataFrame, bins: int = 25) -> DataFrame:
    """Equal-width histogram of each release's placebo effects."""
    span = placebo.groupBy("version").agg(F.min("effect").alias("lo"), F.max("effect").alias("hi"))
    position = (F.col("effect") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins
    index = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(position).cast("int"), F.lit(bins - 1))).otherwise(bins // 2)
    return (placebo.join(span, "version").withColumn("bin", index)
            .groupBy("version", "bin").agg(F.count(F.lit(1)).alias("n")))


def event_study(daily: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every app's negative share around each release."""
    releases = windows.select("version", "adoption_date")
    days = event_days(releases, "adoption_date", list(range(-window, window + 1)))
    series = daily.filter("is_complete_day").select("app_key", "review_date", "negative_share")
    return days.join(series, "review_date").select(
        "version", "adoption_date", "app_key", "review_date", F.col("_offset").alias("relative_day"), "negative_share")


def topic_shift(topic_daily: DataFrame, windows: DataFrame, focus: str, window: int = WINDOW,
                buffer: tuple[int, int] = BUFFER) -> DataFrame:
    """Change of each topic's share (percentage points) from before to after a release.

    The denominator counts each day once, however many topics it has.
    """
    own = topic_daily.filter((F.col("app_key") == focus) & F.col("is_complete_day"))
    days = event_days(windows.select("version", "adoption_date"), "adoption_date", window_offsets(window, buffer))
    volume = own.groupBy("review_date").agg(F.max("n_reviews_that_day").alias("n_day"))
    side = F.when(F.col("post"), F.lit("post")).otherwise(F.lit("pre"))

    def split(value: str, name: str) -> list[Column]:
        return [F.sum(F.when(F.col("post") == after, F.col(value))).alias(f"{name}_{label}")
                for after, label in ((False, "pre"), (True, "post"))]

    reviews = days.join(volume, "review_date").groupBy("version").agg(*split("n_day", "all"))
    counts = (days.join(own.select("review_date", "topic", "n_topic_reviews"), "review_date")
              .withColumn("side", side).groupBy("version", "topic").agg(*split("n_topic_reviews", "topic")))
    shares = counts.join(reviews, "version")

    def share(label: str) -> Column:
        return F.coalesce(ratio(F.col(f"topic_{label}"), F.col(f"all_{label}")), F.lit(0.0))

    return (shares.withColumn("pre_share", share("pre")).withColumn("post_share", share("post"))
            .withColumn("change_pp", (F.col("post_share") - F.col("pre_share")) * 100.0)
            .select("version", "topic", "pre_share", "post_share", "change_pp"))


def prior_versions(adoption: DataFrame, focus: str) -> DataFrame:
    """Each focus release with the latest release adopted on an earlier day."""
    day = F.datediff("adoption_date", F.lit("1970-01-01").cast("date"))
    earlier = Window.partitionBy("app_key").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct("adoption_date", "review_version")).over(earlier)
    return (adoption.filter(F.col("app_key") == focus).withColumn("_day", day)
            .select(F.col("review_version").alias("version"), "adoption_date",
                    latest["review_version"].alias("prior_version")))


def rollout_overlap(cells: DataFrame, adoption: DataFrame, focus: str,
                    days: tuple[int, int] = (-3, 10)) -> DataFrame:
    """Old against new version on the same days: rating ~ is_new + day.

    Centring inside days reduces the fit to sums over the (app, day, version)
    cells of `marts.day_cells`.
    """
    own = (cells.filter((F.col("app_key") == focus) & F.col("review_version").isNotNull())
           .select("review_date", "review_version", "n", "s", "ss"))
    releases = prior_versions(adoption, focus).filter(F.col("prior_version").isNotNull())
    window = event_days(releases, "adoption_date", list(range(days[0], days[1] + 1)))
    pairs = (window.join(own, "review_date")
             .filter(F.col("review_version").isin(F.col("version"), F.col("prior_version"))))
    new = F.col("review_version") == F.col("version")
    per_day = pairs.groupBy("version", "prior_version", "review_date").agg(
        F.sum(F.when(new, F.col("n")).otherwise(0)).cast("double").alias("n1"),
        F.sum(F.when(~new, F.col("n")).otherwise(0)).cast("double").alias("n0"),
        F.sum(F.when(new, F.col("s")).otherwise(0.0)).alias("s1"),
        F.sum(F.when(~new, F.col("s")).otherwise(0.0)).alias("s0"), F.sum("ss").alias("ss"))
    n, s = F.col("n1") + F.col("n0"), F.col("s1") + F.col("s0")
    fit = per_day.groupBy("version", "prior_version").agg(
        F.sum("n1").alias("n_new"), F.sum("n0").alias("n_old"), F.sum("s1").alias("s_new"), F.sum("s0").alias("s_old"),
        F.sum(F.col("n1") * F.col("n0") / n).alias("xx"),
        F.sum(F.col("s1") - F.col("n1") / n * s).alias("xy"),
        F.sum(F.col("ss") - s * s / n).alias("yy"), F.count(F.lit(1)).alias("n_days"))
    beta = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx"))
    dof = F.col("n_new") + F.col("n_old") - F.col("n_days") - 1.0
    scatter = F.col("yy") - F.col("effect") * F.col("xy")
    return (fit.filter((F.col("n_new") > 0) & (F.col("n_old") > 0))
            .withColumn("effect", beta).withColumn("dof", dof)
            .withColumn("se", F.when((dof > 0) & (scatter > 0), F.sqrt(scatter / dof / F.col("xx"))))
            .withColumn("t", F.col("effect") / F.col("se"))
            .withColumn("p_value", student_t_p(F.col("t"), F.col("dof")))
            .select("version", "prior_version", F.col("n_new").cast("bigint").alias("n_new"),
                    F.col("n_old").cast("bigint").alias("n_old"),
                    (F.col("s_new") / F.col("n_new")).alias("mean_new"),
                    (F.col("s_old") / F.col("n_old")).alias("mean_old"), "effect", "se", "p_value"))
