"""Issue cost and the ranked backlog: rating penalties, prevalence, RICE, stability."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import literal_map, ratio
from feedloom.functions.seeded import seeded_digest, seeded_uniform
from feedloom.session import cut_lineage

# The solvers go to the executors with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAILING_DAYS = 90
WORD_BITS = 62        # topics whose marks fit into one number
RIGHT_SIDE = "="      # stands for the rating in the sums of products

INTERCEPT, LOG_LENGTH = "intercept", "log_len"
PENALTY_SCHEMA = """topic string, penalty double, penalty_se double, penalty_p double,
    penalty_ci_low double, penalty_ci_high double"""


def topic_wide(reviews: DataFrame, topics: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One 0/1 column per topic of the vocabulary, also for topics nobody has."""
    marks = [F.max(F.when(F.col("topic") == t, 1).otherwise(0)).alias(f"t_{t}") for t in vocabulary]
    wide = topics.filter(F.col("topic").isin(*vocabulary)).groupBy("review_id").agg(*marks)
    return reviews.select("review_id").join(wide, "review_id", "left").fillna(0)


def review_cells(reviews: DataFrame, topics: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Sums per app, month and topic set that a least-squares fit and its robust errors need.

    All regressors but the log length are constant inside a cell, so the sums
    of products of rating (y) and log length (l) below carry everything: column
    `y1l2` is the sum of y * l^2. The reviews are read once; the cells number
    apps x months x topic sets, however many reviews there are. The topic set
    is a sorted array, so a vocabulary may have any size; until the cells are
    summed it stands as bits in numbers, which plain hash aggregates work on.
    """
    words = sorted(set(vocabulary)) or [""]
    bits = [(f"_b{k}", words[at:at + WORD_BITS]) for k, at in enumerate(range(0, len(words), WORD_BITS))]
    marks = [F.bit_or(F.coalesce(literal_map({t: 1 << i for i, t in enumerate(part)})[F.col("topic")].cast("bigint"), F.lit(0).cast("bigint"))).alias(b)
             for b, part in bits]
    sets = topics.filter(F.col("topic").isin(*vocabulary)).groupBy("review_id").agg(*marks)
    powers = [F.sum(_power("y", i) * _power("l", j)).alias(f"y{i}l{j}") for i, j in _MOMENTS]
    cells = (reviews.select("review_id", "app_key", F.date_format("review_date", "yyyy-MM").alias("month"),
                            F.log1p(F.col("text_length").cast("double")).alias("l"), F.col("rating").cast("double").alias("y"))
             .join(sets, "review_id", "left")
             .groupBy("app_key", "month", *[F.coalesce(b, F.lit(0).cast("bigint")).alias(b) for b, _ in bits]).agg(*powers))
    found = [F.when(F.getbit(b, F.lit(i)) == 1, F.lit(t)) for b, part in bits for i, t in enumerate(part)]
    topic_set = F.filter(F.array(*found), lambda t: t.isNotNull()).cast("array<string>")
    return cells.select("app_key", "month", topic_set.alias("topic_set"), *[f"y{i}l{j}" for i, j in _MOMENTS])


_MOMENTS = [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]


def _power(name: str, exponent: int) -> Column:
    out = F.lit(1.0)
    for _ in range(exponent):
        out = out * F.col(name)
    return out


def _entries() -> Column:
    """Non-zero regressors of a cell: name, and 1 if it stands for the log length."""
    def entry(name: Column, power: int = 0) -> Column:
        return F.struct(name.alias("k"), F.lit(power).alias("p"))

    fixed = F.array(entry(F.lit(INTERCEPT)), entry(F.concat(F.lit("app="), "app_key")),
                    entry(F.concat(F.lit("month="), "month")), entry(F.lit(LOG_LENGTH), 1))
    return F.concat(fixed, F.transform("topic_set", lambda t: entry(F.concat(F.lit("topic="), t))))


def _products(cells: DataFrame, by_power: list[Column]) -> DataFrame:
    """Sums of products of regressor pairs; `by_power[q]` is the cell's weighted sum of l^q."""
    left = cells.withColumn("_w", F.array(*by_power)).withColumn("_a", F.explode("e"))
    both = left.withColumn("_b", F.explode("e")).filter(F.col("_a.k") <= F.col("_b.k"))
    return both.groupBy("g", F.col("_a.k").alias("i"), F.col("_b.k").alias("j")).agg(
        F.sum(F.element_at("_w", F.col("_a.p") + F.col("_b.p") + 1)).alias("v"))


def _squared_error(q: int) -> Column:
    """Cell sum of (y - f - b l)^2 * l^q from the moments; f fits the constants, b the length."""
    f, b = F.col("_f"), F.col("_b")

    def m(i: int, j: int) -> Column:
        return F.col(f"y{i}l{j + q}")

    return (m(2, 0) + f * f * m(0, 0) + b * b * m(0, 2) - 2.0 * f * m(1, 0) - 2.0 * b * m(1, 1)
            + 2.0 * f * b * m(0, 1))


def _matrix(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    at = {name: pos for pos, name in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for a, b, v in zip(rows["i"], rows["j"], rows["v"]):
        if a in at and b in at:
            out[at[a], at[b]] = out[at[b], at[a]] = v
    return out


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Coefficients of one group from its sums of products; minimum norm if columns depend on each other."""
    right = rows[rows["j"] == RIGHT_SIDE].set_index("i")["v"]
    seen = sorted(right.index)
    # The first app and the first month are the base levels.
    base = {min(k for k in seen if k.startswith(p)) for p in ("app=", "month=")}
    names = [k for k in seen if k not in base]
    gram = _matrix(rows, names)
    value, vector = np.linalg.eigh(gram)
    keep = value > value.max() * len(names) * np.finfo(float).eps
    inverse = (vector[:, keep] / value[keep]) @ vector[:, keep].T
    beta = inverse @ right[names].to_numpy()
    at = names.index(INTERCEPT)
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "names": [names], "beta": [beta.tolist()], "inverse": [inverse.ravel().tolist()],
                         "n": [gram[at, at]], "rank": [int(keep.sum())]})


def _robust(model: pd.DataFrame, meat: pd.DataFrame) -> pd.DataFrame:
    """Penalties of one group with HC1 errors; the degrees of freedom count the rank."""
    out = []
    for _, m in model.iterrows():
        names, beta, n, rank = list(m["names"]), m["beta"], m["n"], m["rank"]
        inverse = np.array(m["inverse"]).reshape(len(names), len(names))
        cov = inverse @ _matrix(meat, names) @ inverse * (n / (n - rank) if n > rank else np.nan)
        for pos, name in enumerate(names):
            if name.startswith("topic="):
                b, se = float(beta[pos]), float(math.sqrt(max(cov[pos, pos], 0.0)))
                p = math.erfc(abs(b / se) / math.sqrt(2.0)) if se > 0 else None
                out.append((m["g"], name[len("topic="):], b, se, p, b - 1.96 * se, b + 1.96 * se))
    return pd.DataFrame(out, columns=["g", "topic", "penalty", "penalty_se", "penalty_p", "penalty_ci_low", "penalty_ci_high"])


def rating_penalties(cells: DataFrame, vocabulary: list[str], by: str | None = None) -> DataFrame:
    """rating ~ topics + app + month + log1p(length) by least squares, HC1 errors.

    Both passes run on the cells and return one number per pair of regressors and
    group. Each group's small system is solved by a task; `by` fits one model per
    value of a column. Nothing reaches the driver.
    """
    wanted = cells.withColumn("topic_set", F.filter("topic_set", lambda t: t.isin(*vocabulary)))
    prepared = cut_lineage(wanted.withColumn("g", F.col(by).cast("string") if by else F.lit("all")).withColumn("e", _entries()))
    right = prepared.withColumn("_a", F.explode("e")).groupBy("g", F.col("_a.k").alias("i"), F.lit(RIGHT_SIDE).alias("j")).agg(
        F.sum(F.when(F.col("_a.p") == 1, F.col("y1l1")).otherwise(F.col("y1l0"))).alias("v"))
    gram = _products(prepared, [F.col("y0l0"), F.col("y0l1"), F.col("y0l2")])
    models = cut_lineage(gram.unionByName(right).groupBy("g").applyInPandas(
        _solve, "g string, names array<string>, beta array<double>, inverse array<double>, n double, rank int"))

    known = models.select("g", F.map_from_arrays("names", "beta").alias("_known"))
    constants = F.aggregate(F.filter("e", lambda t: t["p"] == 0), F.lit(0.0),
                            lambda acc, t: acc + F.coalesce(F.col("_known")[t["k"]], F.lit(0.0)))
    errors = (prepared.join(known, "g").withColumn("_f", constants)
              .withColumn("_b", F.coalesce(F.col("_known")[LOG_LENGTH], F.lit(0.0))))
    weighted = errors.select("g", "e", *[_squared_error(q).alias(f"e{q}") for q in range(3)])
    meat = _products(weighted, [F.col("e0"), F.col("e1"), F.col("e2")])
    result = models.groupBy("g").cogroup(meat.groupBy("g")).applyInPandas(_robust, "g string, " + PENALTY_SCHEMA)
    return result.withColumnRenamed("g", by) if by else result.drop("g")


def issue_cost(reviews: DataFrame, topics: DataFrame, flags: DataFrame, penalties: DataFrame,
               trailing_days: int = TRAILING_DAYS) -> DataFrame:
    """Prevalence, churn rate and cost per app and topic over the trailing days.

    Every app gets a row for every topic with a penalty, also when it has none. Topics and flags
    that carry their review's `review_date` are cut to those days before they are joined.
    """
    first = F.date_sub(reviews.agg(F.max("review_date")).scalar(), trailing_days)
    topics, flags = (x.filter(F.col("review_date") >= first) if "review_date" in x.columns else x for x in (topics, flags))
    recent = reviews.filter(F.col("review_date") >= first).select("review_id", "app_key")
    totals = recent.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_total_reviews_90d"))
    churned = flags.select("review_id", "churn_intent")
    # Only the trailing days' topics are made distinct.
    marked = (topics.select("review_id", "topic").join(recent, "review_id")
              .join(penalties.select("topic"), "topic", "left_semi").distinct())
    counts = (marked.join(churned, "review_id", "left")
              .groupBy("app_key", "topic").agg(
                  F.count(F.lit(1)).alias("n_topic_reviews_90d"),
                  F.avg(F.coalesce(F.col("churn_intent"), F.lit(False)).cast("double")).alias("churn_intent_rate")))
    every_topic = penalties.agg(F.collect_list(F.struct(
        "topic", "penalty", "penalty_ci_low", "penalty_ci_high"))).scalar()
    grid = totals.withColumn("_t", F.explode(every_topic)).select("app_key", "n_total_reviews_90d", "_t.*")
    filled = grid.join(counts, ["app_key", "topic"], "left").fillna(0, ["n_topic_reviews_90d", "churn_intent_rate"])
    return (filled.withColumn("prevalence", ratio(F.col("n_topic_reviews_90d"), F.col("n_total_reviews_90d")))
            .withColumn("rating_lift_if_fixed", F.col("prevalence") * F.abs("penalty"))
            .withColumn("churn_exposure", F.col("prevalence") * F.col("churn_intent_rate"))
            .select("app_key", "topic", "prevalence", "n_topic_reviews_90d", "n_total_reviews_90d", "churn_intent_rate",
                    "penalty", "penalty_ci_low", "penalty_ci_high", "rating_lift_if_fixed", "churn_exposure"))


def impact_score(lift: Column) -> Column:
    # The impact steps of the rating lift.
    return (F.when(lift >= 0.03, 3.0).when(lift >= 0.015, 2.0).when(lift >= 0.005, 1.0)
            .when(lift >= 0.001, 0.5).otherwise(0.25))


def confidence_score(f1: Column) -> Column:
    # Classifier quality to confidence; an unscored topic counts as 0.4.
    known = F.coalesce(f1, F.lit(0.4))
    return F.when(known >= 0.6, 1.0).when(known >= 0.45, 0.8).otherwise(0.5)


def rice(costs: DataFrame, downloads: dict[str, int], topic_f1: dict[str, float],
         effort_weeks: dict[str, float]) -> DataFrame:
    """Reach x impact x confidence / effort per app and topic."""
    def number(values: dict) -> dict:
        return {k: float(v) for k, v in values.items()}

    return (costs
            .withColumn("reach", literal_map(number(downloads))[F.col("app_key")] * F.col("prevalence"))
            .withColumn("impact", impact_score(F.col("rating_lift_if_fixed")))
            .withColumn("confidence", confidence_score(literal_map(number(topic_f1))[F.col("topic")]))
            .withColumn("effort_weeks", literal_map(number(effort_weeks))[F.col("topic")])
            .withColumn("rice", F.col("reach") * F.col("impact") * F.col("confidence") / F.col("effort_weeks")))


def top_issues(scored: DataFrame, top: int = 5) -> DataFrame:
    order = Window.partitionBy("app_key").orderBy(F.col("rice").desc_nulls_last(), "topic")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rice_stability(scored: DataFrame, runs: int = 1000, top: int = 3, seed: int = 7) -> DataFrame:
    """Share of runs in which a topic stays in its app's top when efforts vary by half."""
    spread = scored.select("app_key", "topic", "reach", "impact", "confidence", "effort_weeks").withColumn(
        "_run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    noise = seeded_uniform(seed, F.col("app_key"), F.col("topic"), F.col("_run")) + 0.5
    simulated = F.col("reach") * F.col("impact") * F.col("confidence") / (F.col("effort_weeks") * noise)
    order = Window.partitionBy("app_key", "_run").orderBy(F.col("_rice").desc_nulls_last(), "topic")
    kept = (spread.withColumn("_rice", simulated).withColumn("_rank", F.row_number().over(order))
            .groupBy("app_key", "topic").agg(F.count_if(F.col("_rank") <= top).alias("_n")))
    return scored.join(kept, ["app_key", "topic"]).withColumn(
        "top3_stability_pct", F.col("_n") / float(runs) * 100.0).drop("_n")


def issue_examples(topics: DataFrame, issues: DataFrame, per_issue: int = 2, max_rating: int = 2,
                   seed: int = 54) -> DataFrame:
    """Random negative examples for each listed app and topic.

    `topics` carries `rating`; texts are joined to the chosen ids. The dense rank limits rows
    before the shuffle; a pair that is listed twice shares its rank, so the
    duplicates go when only the few chosen rows are left.
    """
    order = Window.partitionBy("app_key", "topic").orderBy(
        seeded_digest(seed, F.col("review_id"), F.col("topic")), "review_id")
    return (topics.filter(F.col("rating") <= max_rating)
            .join(issues.select("app_key", "topic"), ["app_key", "topic"], "left_semi")
            .withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= per_issue)
            .select("app_key", "topic", "review_id").distinct())
