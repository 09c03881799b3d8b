"""Prefilters, snippets, bins, sketches, operating curve, bounded join keys, plans of all queries."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from feedloom.functions import text
from feedloom.operators import alerts, explore, labels, sampling, staging
from feedloom.plans import catalog

T0 = dt.datetime(2024, 1, 1)


def hour(h):
    return T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("pattern, needed", [
    (r"(too many ads|pop.?up)", ["pop", "too many ads"]), (r"a.*bcd+", ["bc"]), (r"x?y*", None), (r"(ab|c)?", None), (r"ab(cd|efg)", ["ab"]), (r"(?:[0-9]+) eur", [" eur"])])
def test_every_match_holds_a_needed_string(pattern, needed):
    assert text.needed_literals(pattern) == needed


def test_prefiltered_patterns_find_what_the_patterns_find(spark):
    r = random.Random(1)
    pieces = re.findall(r"[a-z ]+", " ".join(sampling.RARE_TOPIC_PATTERNS.values())) + ["auto-debit", "popup", "refund is pending", "nahi", "\n"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", ".", "x"]) for _ in range(r.randint(0, 5))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.hits for x in df.select("i", text.labels_matching(F.col("t"), sampling.RARE_TOPIC_PATTERNS).alias("hits")).collect()}
    assert got == {i: [n for n, p in sampling.RARE_TOPIC_PATTERNS.items() if re.search(p, t)] for i, t in enumerate(texts)}
    churn = {x.i for x in df.filter(text.matches(F.col("t"), sampling.CHURN_PATTERN)).collect()}
    assert churn == {i for i, t in enumerate(texts) if re.search(sampling.CHURN_PATTERN, t)}


def test_snippet(spark):
    df = spark.createDataFrame([("é\n" * 100,), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.snippet(F.col("t"), 5)).collect()] == ["é é é", "a", "", None]


def test_bins_are_filled_from_one_reading(spark):
    rows = [("a", hour(0), 1), ("a", hour(7), 5), ("b", hour(3), 1), ("a", hour(1), 2)]
    df = spark.createDataFrame(rows, "app_key string, reviewed_at timestamp_ntz, rating int")
    bins = alerts.review_bins(df, {"a": 2}, 3)
    got = sorted((r.app_key, r.bin_start, r.n_reviews, r.n_negative) for r in bins.collect())
    assert got == [("a", hour(0), 2, 2), ("a", hour(2), 0, 0), ("a", hour(4), 0, 0), ("a", hour(6), 1, 0), ("b", hour(3), 1, 1)]
    assert bins._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_sketches_merge_for_any_span(spark):
    r = random.Random(5)
    rows = [(a, dt.date(2024, 1, 1 + r.randint(0, 19)), int(r.lognormvariate(4, 1.5))) for a in "ab" for _ in range(4000)] + [("c", dt.date(2024, 1, 1), 7)]
    df = spark.createDataFrame(rows, "app_key string, review_date date, text_length int")
    sketches = explore.length_sketches(df)
    assert sketches.count() == 41
    for part, sketched in ((df, sketches), (df.filter("review_date > '2024-01-10'"), sketches.filter("review_date > '2024-01-10'"))):
        errors = explore.rank_errors(part, explore.sketched_percentiles(sketched)).collect()
        assert len(errors) == 3 * part.select("app_key").distinct().count() and all(e.rank_error < 0.02 for e in errors)
        assert {e.app_key: e.n for e in errors} == {x.app_key: x["count"] for x in part.groupBy("app_key").count().collect()}
    wrong = explore.sketched_percentiles(sketches).withColumn("estimate", F.lit(1).cast("bigint"))
    assert explore.rank_errors(df, wrong).agg(F.max("rank_error")).first()[0] > 0.9


def curve_by_hand(bins, incidents, settings, most, before, after):
    apps = sorted({b[0] for b in bins})
    weeks = sum((max(b[1] for b in bins if b[0] == a) - min(b[1] for b in bins if b[0] == a)).days / 7 for a in apps)
    out, hits = {}, {}
    for s in settings:
        starts = []
        for a in apps:
            last = None
            for _, start, n, p, z in sorted(b for b in bins if b[0] == a):
                if n >= s[1] and (p < s[0] or z > s[2]):
                    if last is None or start - last > dt.timedelta(hours=4):
                        starts.append((a, start))
                    last = start
        near = lambda a, t, i: i[1] == a and i[2] - dt.timedelta(hours=before) <= t <= i[2] + dt.timedelta(hours=after)
        hits[s] = {i[0] for i in incidents for a, t in starts if near(a, t, i)}
        false = sum(not any(near(a, t, i) for i in incidents) for a, t in starts)
        out[s] = [len(starts), false, false / weeks]

    def best(without=None):
        def rank(s):
            k, ok = len(hits[s] - {without}), out[s][2] <= most
            return (not ok, -k if ok else 0, out[s][1], -k, s[0], -s[1], -s[2])
        return min(settings, key=rank)
    names = sorted({i[0] for i in incidents})
    return {s: (*out[s][:2], len(hits[s]), s == best(), sum(best(i) == s for i in names), sum(best(i) == s and i in hits[s] for i in names)) for s in settings}


@pytest.mark.parametrize("seed, most", [(1, 1.0), (2, 0.2), (3, 50.0)])
def test_operating_curve_equals_brute_force(spark, seed, most):
    r = random.Random(seed)
    bins = [(a, hour(h), r.choice([0, 0, 0, 2, 3, 6]), r.choice([0.0005, 0.03, 0.5]), r.choice([0.0, 2.5, 4.0])) for a in "ab" for h in range(24 * 15)]
    incidents = [(f"i{k}", r.choice("ab"), hour(r.randint(0, 24 * 15))) for k in range(5)]
    settings = [(a, m, z) for a in (0.001, 0.05) for m in (2, 3, 7) for z in (2.0, 3.0, 9.0)]
    scored = spark.createDataFrame([(*b, 1) for b in bins], "app_key string, bin_start timestamp_ntz, n_negative long, poisson_p double, z double, bin_hours int")
    log = spark.createDataFrame([(i, a, t, t) for i, a, t in incidents], "incident_id string, app_key string, start_time_ist timestamp_ntz, first_public_report_ist timestamp_ntz")
    got = {(x.alpha, x.min_count, x.z_threshold): (x.n_episodes, x.n_false, x.n_caught, x.chosen, x.n_chosen_without, x.n_held_out_caught)
           for x in alerts.operating_curve(scored, log, settings, most, 3, 12).collect()}
    assert got == curve_by_hand(bins, incidents, settings, most, 3, 12)


def test_thresholds_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(t, r.randint(0, 1), r.choice([0.0, 0.1, 0.25, 0.3, 0.5, r.random(), 1.0])) for t in "xyz" for _ in range(60)] + [("none", 0, 0.05)]
    grid = [0.5, 0.1, 0.25, 0.3]
    got = {x.topic: (x.threshold, round(x.f1, 12)) for x in labels.best_thresholds(spark.createDataFrame(rows, "topic string, truth int, probability double"), grid).collect()}

    def f1(t, g):
        tp, pred, real = (sum(1 for a, y, p in rows if a == t and c(y, p)) for c in (lambda y, p: y and p >= g, lambda y, p: p >= g, lambda y, p: y))
        return 2 * tp / (pred + real) if pred + real else 0.0
    assert got == {t: max(((g, round(f1(t, g), 12)) for g in sorted(grid)), key=lambda x: (x[1], -x[0])) for t in ("x", "y", "z", "none")}


def test_flag_agreement_counts_missing_as_no(spark):
    df = spark.createDataFrame([(1, True), (0, True), (None, False), (1, True)], "h int, o boolean")
    row = labels.flag_agreement(df, "h", "o").first()
    assert (row.human_positives, row.other_positives, row.n_rows, row.kappa) == (2, 3, 4, 0.5)


def test_a_review_id_with_a_third_of_the_topic_rows_adds_no_long_task(spark, tmp_path):
    """Counted before the join it has a row per topic; joined row by row, Spark splits it."""
    n = 60_000
    raw = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 5000)).alias("review_id"),
                                F.concat(F.lit("topic"), F.col("id") % 7).alias("topic"), (F.col("id") / n).alias("probability"))
    path = str(tmp_path / "reviews")
    raw.select("review_id").distinct().withColumns({"app_key": F.lit("a"), "review_date": F.lit(T0.date()), "review_hour": F.lit(T0)}).write.parquet(path)
    reviews = spark.read.parquet(path)
    counts = staging.topic_counts(raw)
    assert counts.filter("review_id = 'hot'").count() == 7 and counts.agg(F.sum("n_rows")).first()[0] == n
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = staging.stage_topics(raw.repartition(8), reviews)
        assert joined.count() == n
        joined = staging.stage_topics(raw, reviews)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Building these runs model fits or whole publishing runs; their own tests cover them.
HEAVY = {"dq_report", "published_tables", "saved_topic_scores", "topic_scores", "churn_scores", "held_out_scores", "text_topic_scores"}


@pytest.mark.parametrize("name", sorted(set(catalog.BUILDERS) - HEAVY))
def test_no_plan_compares_all_pairs(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------- size of tasks

def test_written_frames_run_in_small_tasks(spark):
    from feedloom import session

    keys, seen = (*session.PIECES, "spark.sql.shuffle.partitions"), {}

    class Probe:
        def __init__(self, df):
            self.df, self.sparkSession, self.schema, self.write = df, df.sparkSession, df.schema, self

        def parquet(self, path):
            seen.update({k: spark.conf.get(k) for k in keys})
            self.df.write.parquet(path)

    before = {k: spark.conf.get(k) for k in keys}
    assert session.cut_lineage(Probe(spark.range(3))).count() == 3
    assert [seen[k] for k in keys] == [*(f"{v}b" for v in session.PIECES.values()), str(session.PARTITIONS)]
    assert {k: spark.conf.get(k) for k in keys} == before

    spark.conf.set(keys[1], "64k")          # smaller pieces stay, also after a job that fails
    try:
        with pytest.raises(ZeroDivisionError), session.small_tasks(spark):
            assert spark.conf.get(keys[1]) == f"{64 << 10}b"
            raise ZeroDivisionError
        assert spark.conf.get(keys[1]) == "64k"
    finally:
        spark.conf.set(keys[1], before[keys[1]])


@pytest.mark.parametrize("name", ["topic_cooccurrence", "topic_quality_metrics", "topic_coverage", "daily_topic_metrics", "first_topic_cohort", "topic_prevalence"])
def test_joins_of_all_topic_rows_are_written(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_cells_of_a_vocabulary_of_more_topics_than_a_number_has_bits(spark):
    from feedloom.operators import backlog

    words = [f"t{k}" for k in range(150)]
    sets = {"a": ["t0", "t9", "t149", "t75"], "b": ["t61", "t62", "t63"], "c": [], "d": ["t0", "t9", "t149", "t75"]}
    reviews = spark.createDataFrame([(r, "app", dt.date(2024, 1, 5), 10, 4) for r in sets], "review_id string, app_key string, review_date date, text_length int, rating int")
    topics = spark.createDataFrame([(r, t) for r, ts in sets.items() for t in [*ts, *ts, "other", None]], "review_id string, topic string")
    cells = backlog.review_cells(reviews, topics, words)
    assert {(tuple(c.topic_set), c.y0l0, c.y1l0) for c in cells.collect()} == {
        (tuple(sorted(sets["a"])), 2.0, 8.0), (tuple(sorted(sets["b"])), 1.0, 4.0), ((), 1.0, 4.0)}
    empty = backlog.review_cells(reviews, topics, [])
    assert [(c.topic_set, c.y0l0) for c in empty.collect()] == [([], 4.0)]
    assert "ObjectHashAggregate" not in cells._jdf.queryExecution().executedPlan().toString()
