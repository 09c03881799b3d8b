"""Operators on small hand-made frames with hand-worked results."""

import datetime as dt
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import alerts, backlog, causal, classifiers, explore, labels, marts, quality, sampling, staging, switching
from feedloom.plans import fixtures as fx
from feedloom.sources import files, reviews as landing, schemas

RAW = "reviewId string, content string, score int, thumbsUpCount int, reviewCreatedVersion string, at timestamp_ntz, " \
      "replyContent string, user_hash string, app_key string, scraped_at timestamp_ntz"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute) + dt.timedelta(days=day)


def raw(spark, rows):
    return spark.createDataFrame([(i, c, s, 0, v, a, r, "u", "app", sc) for i, c, s, v, a, r, sc in rows], RAW)


def test_latest_copy_wins_and_an_empty_latest_copy_hides_older_ones(spark):
    df = raw(spark, [("1", " old ", 1, None, at(0), None, at(1)), ("1", " new ", 5, "v2", at(0), "hi", at(2)),
                     ("2", "text", 2, None, at(0), None, at(1)), ("2", "   ", 2, None, at(0), None, at(3)),
                     ("3", None, 3, None, at(0), None, at(1)), ("4", "tie", 4, None, at(1), None, at(1)),
                     ("4", "tie", 3, None, at(0), None, at(1))])
    out = {r.review_id: r for r in staging.stage_reviews(df).collect()}
    assert set(out) == {"1", "4"}
    assert (out["1"].review_text, out["1"].rating, out["1"].has_dev_reply, out["1"].text_length) == ("new", 5, True, 3)
    assert out["4"].rating == 4


def test_one_review_with_a_third_of_all_rows(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("review_id"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("scraped_at"))
    ranked = staging.latest_copy(hot, tie_break=())
    assert ranked.count() == 20001
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()
    assert ranked.filter("review_id = 'hot'").first().scraped_at == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=29997)


def test_adoption_ignores_the_last_two_days_and_unversioned_reviews(spark):
    rows = [(f"{d}-{i}", "x", 3, "v1" if i < 19 else "v2", at(d), None, at(d)) for d in range(1, 5) for i in range(20)]
    rows += [(f"n{i}", "x", 3, None, at(5), None, at(5)) for i in range(3)] + [("late", "x", 3, "v9", at(5), None, at(5))]
    out = marts.version_adoption(staging.stage_reviews(raw(spark, rows)), min_reviews=3).collect()
    got = {r.review_version: (r.adoption_date, r.total_reviews) for r in out}
    assert got == {"v1": (dt.date(2024, 1, 2), 57), "v2": (dt.date(2024, 1, 2), 3)}


def test_episode_merge_is_inclusive_at_gap_plus_bin(spark):
    bins = spark.createDataFrame([("a", 1, at(0, h), True, p) for h, p in ((1, .004), (5, .002), (10, .009))],
                                 "app_key string, bin_hours int, bin_start timestamp_ntz, alert boolean, poisson_p double")
    out = sorted((r.start, r.end, r.peak_p) for r in alerts.episodes(bins).collect())
    assert out == [(at(0, 1), at(0, 5), .002), (at(0, 10), at(0, 10), .009)]


def test_baseline_needs_five_rows_and_zero_mad_still_alerts(spark):
    reviews = [(f"{d}-{i}", "a", at(d, 9), 1) for d in range(8) for i in range(1 if d < 7 else 9)]
    df = spark.createDataFrame(reviews, "review_id string, app_key string, reviewed_at timestamp_ntz, rating int")
    scored = alerts.scored_bins(df, {"a": 24}, 24).orderBy("bin_start").collect()
    assert [r.baseline_mean for r in scored[:5]] == [None] * 5 and not any(r.alert for r in scored[:7])
    last = scored[7]
    assert (last.baseline_mad, last.z, last.alert) == (0.0, 8.0, True)


def panel(spark, seed=3, days=70, drop=()):
    rng = np.random.default_rng(seed)
    rows = []
    for a in ("f", "c1", "c2"):
        for d in range(days):
            if (a, d) not in drop:
                rows.append((a, (at(d)).date(), int(rng.integers(5, 60)), float(rng.random()), True))
    return rows, spark.createDataFrame(rows, "app_key string, review_date date, n_reviews int, negative_share double, is_complete_day boolean")


@pytest.mark.parametrize("drop", [(), (("c1", 20), ("f", 30), ("c2", 41), ("c1", 41))])
def test_did_effect_equals_dummy_variable_least_squares(spark, drop):
    rows, df = panel(spark, drop=drop)
    event = at(35).date()
    dates = spark.createDataFrame([(event,)], "event_date date")
    got = causal.did_effects(df, dates, "f", ["c1", "c2"]).first().effect
    offsets = causal.window_offsets()
    used = [r for r in rows if (r[1] - event).days in offsets]
    day_names = sorted({r[1] for r in used})
    x = np.array([[float(r[0] == "f" and r[1] > event), 1.0, float(r[0] == "c1"), float(r[0] == "c2")]
                  + [float(r[1] == d) for d in day_names[1:]] for r in used])
    w = np.sqrt(np.array([r[2] for r in used], dtype=float))
    beta = np.linalg.lstsq(x * w[:, None], np.array([r[3] for r in used]) * w, rcond=None)[0]
    assert got == pytest.approx(beta[0], abs=1e-10)


def test_did_effect_is_null_without_enough_days_or_controls(spark):
    _, df = panel(spark)
    dates = spark.createDataFrame([(at(1).date(),), (at(35).date(),)], "event_date date")
    assert {r.event_date: r.effect is None for r in causal.did_effects(df, dates, "f", ["c1", "c2"]).collect()} == {
        at(1).date(): True, at(35).date(): False}
    alone = df.filter("app_key = 'f' or review_date < date'2024-02-01'")
    assert causal.did_effects(alone, dates.filter("event_date > date'2024-01-10'"), "f", ["c1", "c2"]).first().effect is None


def test_benjamini_hochberg_by_hand(spark):
    df = spark.createDataFrame([("a", .01), ("b", .04), ("c", .03), ("d", .50), ("e", None)], "v string, p double").withColumn("f", F.lit(1))
    q = {r.v: r.q_value for r in causal.benjamini_hochberg(df, "p", "v", "f").collect()}
    assert q["e"] is None
    assert [round(q[k], 6) for k in "abcd"] == [.04, round(.04 * 4 / 3, 6), round(.04 * 4 / 3, 6), .5]


def _mentions_by_regex(t, aliases):
    return [a for a, v in aliases.items() if re.search(r"(?<![a-z])(" + "|".join(map(re.escape, v)) + r")(?![a-z])", t, re.I)]


def _relation_by_regex(t, variants):
    app = "(?:" + "|".join(map(re.escape, variants)) + ")"
    for relation, patterns in switching.RELATION_PATTERNS.items():
        if any(re.search(p.replace("{app}", app), t, re.I) for p in patterns):
            return relation
    return "none"


def test_mentions_and_relations_against_brute_force(spark):
    texts = ["Switching to AlphaPay", "came from beta  pay", "came from beta pay and unlike alphapay", "GAMMA PAY is actually faster",
             "i'm using zeta.pay now", "zetaXpay", "left deltapay", "previously used betapay", "uninstalled it and try alpha-pay",
             "alphapays", "go back to use the gammapay", "alpha pay app is so much better", "no brand here", "AlphaKay", "ALPHAPAYİ"]
    df = spark.createDataFrame([(str(i), "betapay", 1, t, dt.date(2024, 1, 1)) for i, t in enumerate(texts)],
                               "review_id string, app_key string, rating int, review_text string, review_date date")
    got = {(r.review_id, r.other_app): r.relation for r in switching.relations(
        switching.mention_candidates(df, fx.ALIASES), fx.ALIASES).collect()}
    want = {(str(i), a): _relation_by_regex(t, fx.ALIASES[a]) for i, t in enumerate(texts)
            for a in _mentions_by_regex(t, fx.ALIASES) if a != "betapay"}
    assert got == want and {"switching_away", "comparison_only"} <= set(got.values())


def test_flows_from_an_untracked_source_have_no_rate(spark):
    rel = spark.createDataFrame([("1", "a", "x", "switched_from_competitor"), ("2", "a", "x", "switching_away"), ("3", "a", "b", "none")],
                                "review_id string, app_key string, other_app string, relation string")
    totals = spark.createDataFrame([("a", 50), ("b", 10)], "app_key string, n long")
    out = {(r.source, r.dest): r for r in switching.bootstrap_ci(switching.flow_counts(switching.flows(rel), totals), runs=200).collect()}
    assert out["x", "a"].per_10k is None and out["x", "a"].per_10k_ci_low is None
    assert out["a", "x"].per_10k == 200.0 and out["a", "x"].per_10k_ci_low == 0.0 and out["a", "x"].per_10k_ci_high >= 600.0


def test_penalties_equal_numpy_ols_with_hc1(spark):
    rng = np.random.default_rng(5)
    n, vocabulary = 600, ["t1", "t2", "never"]
    apps, months = rng.integers(0, 3, n), rng.integers(1, 4, n)
    length, hit = rng.integers(1, 80, n), rng.random((n, 2)) < [.3, .6]
    y = np.clip(np.round(3 - 1.2 * hit[:, 0] + .2 * apps + rng.normal(0, 1, n)), 1, 5)
    reviews = spark.createDataFrame([(str(i), f"app{apps[i]}", dt.date(2024, int(months[i]), 3), int(length[i]), int(y[i])) for i in range(n)],
                                    "review_id string, app_key string, review_date date, text_length int, rating int")
    topics = spark.createDataFrame([(str(i), f"t{j + 1}") for i in range(n) for j in range(2) if hit[i, j]], "review_id string, topic string")
    out = {r.topic: r for r in backlog.rating_penalties(backlog.review_cells(reviews, topics, vocabulary), vocabulary).collect()}
    x = np.column_stack([np.ones(n), hit, *[apps == a for a in (1, 2)], *[months == m for m in (2, 3)], np.log1p(length)]).astype(float)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    cov = inv @ (x.T * e ** 2) @ x @ inv * n / (n - x.shape[1])
    assert set(out) == {"t1", "t2"}
    for j, t in enumerate(("t1", "t2")):
        se = math.sqrt(cov[j + 1, j + 1])
        assert out[t].penalty == pytest.approx(beta[j + 1], abs=1e-9)
        assert out[t].penalty_se == pytest.approx(se, rel=1e-8)
        assert out[t].penalty_p == pytest.approx(math.erfc(abs(beta[j + 1] / se) / math.sqrt(2)), rel=1e-6)


def test_issue_cost_keeps_zero_cells(spark):
    reviews = spark.createDataFrame([("1", "a", dt.date(2024, 5, 1)), ("2", "b", dt.date(2024, 5, 1)), ("3", "a", dt.date(2024, 1, 1))],
                                    "review_id string, app_key string, review_date date")
    topics = spark.createDataFrame([("1", "t"), ("1", "t"), ("3", "t")], "review_id string, topic string")
    flags = spark.createDataFrame([("1", True)], "review_id string, churn_intent boolean")
    pen = spark.createDataFrame([("t", -1.0, -1.5, -0.5)], "topic string, penalty double, penalty_ci_low double, penalty_ci_high double")
    out = {r.app_key: r for r in backlog.issue_cost(reviews, topics, flags, pen).collect()}
    assert (out["a"].n_topic_reviews_90d, out["a"].n_total_reviews_90d, out["a"].churn_exposure) == (1, 1, 1.0)
    assert (out["b"].n_topic_reviews_90d, out["b"].prevalence, out["b"].churn_intent_rate) == (0, 0.0, 0.0)


def test_issue_cost_is_the_same_from_labels_with_dates_and_joins_only_those_days(spark):
    days = [("1", dt.date(2024, 5, 1)), ("2", dt.date(2024, 5, 1)), ("3", dt.date(2024, 1, 1)), ("4", None), ("5", dt.date(2024, 2, 1))]
    reviews = spark.createDataFrame([(i, "a", d) for i, d in days], "review_id string, app_key string, review_date date")
    topics = spark.createDataFrame([(i, t) for i, _ in days for t in ("t", "u") if i != "2" or t == "t"], "review_id string, topic string")
    flags = spark.createDataFrame([("1", True), ("2", None), ("3", True), ("5", True)], "review_id string, churn_intent boolean")
    pen = spark.createDataFrame([(t, -1.0, -1.5, -0.5) for t in "tu"], "topic string, penalty double, penalty_ci_low double, penalty_ci_high double")
    dated = [x.join(reviews.drop("app_key"), "review_id") for x in (topics, flags)]
    plain, cut = (sorted(map(tuple, backlog.issue_cost(reviews, *x, pen).collect())) for x in ((topics, flags), dated))
    assert plain == cut and [r[1:4] for r in cut] == [("t", 1.0, 3), ("u", 2 / 3, 2)]
    plan = backlog.issue_cost(reviews, *dated, pen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("review_date#") and len(re.findall(r"Filter .*>= date_sub\(scalar-subquery", plan)) >= 3


def test_only_ratings_that_can_be_sampled_are_ranked(spark):
    def row(i):
        rating = None if i % 41 == 0 else i % 5 + 1
        return (str(i), None if i % 7 == 0 else "ab"[i % 2], None if i % 11 == 0 else "tuv"[i % 3], dt.date(2024, 1 + i % 4, 1 + i % 28) if i % 13 else None, rating)

    rows = [row(i) for i in range(3000)] + [row(i) for i in range(0, 3000, 9)] + [(f"n{i}", "z", "t", dt.date(2024, 1, 1), None if i < 12 else 1) for i in range(20)]
    topics = spark.createDataFrame(rows, "review_id string, app_key string, topic string, review_date date, rating int")
    ranked = marts.worst_rated(topics)
    assert ranked.columns == topics.columns and ranked.count() < 2100 and ranked.filter("app_key = 'z'").count() == 12
    want, got = ([tuple(r) for r in marts.review_samples(x).collect()] for x in (topics, ranked))
    assert sorted(want, key=str) == sorted(got, key=str)


def test_impact_and_confidence_steps(spark):
    df = spark.createDataFrame([(.03, .6), (.015, .45), (.005, .44), (.001, None), (.0009, .7)], "lift double, f1 double")
    out = df.select(backlog.impact_score(F.col("lift")).alias("i"), backlog.confidence_score(F.col("f1")).alias("c")).collect()
    assert [tuple(r) for r in out] == [(3.0, 1.0), (2.0, .8), (1.0, .5), (.5, .5), (.25, 1.0)]


def test_samples_are_disjoint_and_small_strata_are_kept_whole(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("review_id"), F.lit("a").alias("app_key"),
                                  F.when(F.col("id") < 10, 3).otherwise(5).alias("rating"), F.lit("never use this again").alias("review_text"),
                                  (F.col("id") % 50 + 1).cast("int").alias("text_length"))
    sample = sampling.split_dev_test(sampling.stratified_sample(df)).cache()
    assert {r.stratum: r["count"] for r in sample.groupBy("stratum").count().collect()} == {"a_neutral": 10, "a_positive": 67}
    assert sample.filter("split = 'dev'").count() == 2 + 17
    assert sample.agg(F.avg("text_length")).first()[0] > 26
    boost = sampling.keyword_sample(df, sample, {"x": "never use", "y": "again"}, per_topic=5)
    assert boost.join(sample, "review_id", "left_semi").count() == 0 and boost.select("review_id").distinct().count() == boost.count()
    index = sampling.shuffled_index(df, "review_id", 1).select("i").collect()
    assert sorted(r.i for r in index) == list(range(3000))


def test_agreement_by_hand(spark):
    rows = [(["t"], ["t"])] * 6 + [(["t"], [])] * 2 + [([], ["t"])] * 1 + [([], [])] * 11
    df = spark.createDataFrame(rows, "human array<string>, other array<string>")
    out = {r.topic: r for r in labels.agreement(labels.confusion(labels.label_grid(df, ["t", "none"], "human", "other"))).collect()}
    po, pe = 17 / 20, (7 * 8 + 12 * 13) / 400
    assert out["t"].kappa == round((po - pe) / (1 - pe), 3)
    assert (out["t"].precision, out["t"].recall, out["t"].f1) == (.857, .75, .8)
    assert out["none"].kappa is None and out["none"].note == labels.NOT_SCOREABLE


def test_label_batches_incidents_and_exports(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for lo in (0, 2):
        batch = [{"i": i, "topics": ["x", "y"][: i % 2 + 1], "churn_intent": bool(i), "competitor_mentioned": None} for i in (lo, lo + 1)]
        (tmp_path / "b" / f"batch_{lo}.json").write_text(json.dumps(batch, indent=1))
    batch = files.read_label_batches(spark, str(tmp_path / "b" / "batch_*.json"))
    assert all(r.passed for r in labels.batch_integrity(batch, 4).collect())
    assert not all(r.passed for r in labels.batch_integrity(batch.filter("i <> 1"), 4).collect())
    (tmp_path / "inc.csv").write_text('incident_id,apps_affected,start_time_ist,first_public_report_ist,type,source_1,source_2,source_3,source_4,notes\n'
                                      'I1,"a;b",2024-01-02 19:45,2024-01-02 20:15,x,s,s,s,s,"two\nlines, ""quoted"""\n')
    rows = files.incident_apps(files.read_incidents(spark, str(tmp_path / "inc.csv"))).collect()
    assert [r.app_key for r in rows] == ["a", "b"] and rows[0].notes == 'two\nlines, "quoted"' and rows[0].start_time_ist == at(1, 19, 45)
    assert files.export_csv({"t": batch.select("i")}, str(tmp_path / "out")) == {"t": 4}
    files.replace_path(batch.select("i"), str(tmp_path / "p"), {"app_key": "a"})
    files.replace_path(batch.select("i"), str(tmp_path / "p"), {"app_key": "a"})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_landing_unites_files_by_name(spark, tmp_path):
    path = str(tmp_path / "landing")
    one = spark.createDataFrame([("1", "n1", "img")], "reviewId string, userName string, userImage string")
    landing.append_pages(landing.pseudonymise(one), path, "a", at(0))
    landing.append_pages(spark.createDataFrame([("2", "x")], "reviewId string, extra string"), path, "b", at(1))
    rows = {r.reviewId: r for r in landing.read_pages(spark, path).collect()}
    assert len(rows["1"].user_hash) == 16 and rows["1"].extra is None and rows["2"].user_hash is None and rows["2"].app_key == "b"
    assert landing.read_pages(spark, path, schemas.RAW_REVIEWS).count() == 2


def test_quality_checks_count_violations(spark):
    df = spark.createDataFrame([("1", 1), ("1", 9), (None, None)], "k string, v int")
    parts = quality.report(quality.row_checks(df, "t", ("k",), {"v": [1]}, {"v": (0, 5)}), quality.unique_check(df, "t", "k"),
                           quality.reference_check(df, "t", "k", df.filter("v = 7"), "k"))
    assert {(r.check_name, r.n_violations) for r in parts.collect()} == {
        ("not_null", 1), ("accepted_values", 1), ("in_range", 1), ("unique", 1), ("relationships", 2)}


def test_classifier_learns_balanced_topics_and_refuses_leakage(spark):
    words = ["refund late money", "crash freeze slow", "great nice love"]
    rows = [(str(i), f"{words[i % 3]} w{i % 7}", [f"t{i % 3}"]) for i in range(90)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, topics array<string>")
    encoder = classifiers.text_encoder(n_features=256).fit(df)
    features = classifiers.encode_text(encoder, df)
    model = classifiers.fit_topics(features, ["t0", "absent", "t1", "t2"])
    assert model.vocabulary() == ["t0", "absent", "t1", "t2"] and model.getOrDefault("gradientNorm") <= 1e-10
    scores = classifiers.topic_probabilities(model, features)
    assert {(r.topic, r.probability) for r in scores.filter("topic = 'absent'").collect()} == {("absent", 0.0)}
    always = classifiers.topic_probabilities(classifiers.fit_topics(features.filter("topics[0] = 't0'"), ["t0", "t1"]), features)
    assert {(r.topic, r.probability) for r in always.collect()} == {("t0", 1.0), ("t1", 0.0)}
    assert scores.count() == 4 * len(rows) and classifiers.bounded(df, "review_id", 1000).count() == 90
    assert 5 < classifiers.bounded(df, "review_id", 30).count() < 60
    found = classifiers.positive_topics(scores).collect()
    assert {(r.review_id, r.topic) for r in found} == {(r[0], r[2][0]) for r in rows}
    _, check = classifiers.assemble_training([df.filter("review_id < '5'"), df.limit(1)], df.filter("review_id >= '9'"))
    assert check.first().n_leaked == 0
    _, check = classifiers.assemble_training([df.filter("review_id < '5'"), df.filter("review_id = '90' or review_id = '89'")], df.filter("review_id >= '9'"))
    assert (check.first().n_leaked, check.first().passed) == (0, True)
    _, check = classifiers.assemble_training([df.filter("review_id < '5'"), df.filter("review_id = '9'")], df.filter("review_id >= '9'"))
    assert (check.first().n_leaked, check.first().passed) == (1, False)


def test_word_histogram_has_a_bin_for_long_texts(spark):
    df = spark.createDataFrame([("a", "one two three"), ("a", "w " * 59 + "w"), ("a", "w " * 99 + "w")], "app_key string, review_text string")
    assert sorted((r.n_words, r.n) for r in explore.word_histogram(df).collect()) == [(3, 1), (41, 2)]


def test_batch_checks_find_lost_and_doubled_records(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (4,)], "i long")
    assert {r.check: r.n_violations for r in labels.batch_integrity(df, 6).collect()} == {"expected_count": 2, "unique_index": 1, "contiguous_index": 1}
    assert labels.merge_checked(df.distinct(), spark.createDataFrame([(0,), (0,), (4,), (9,)], "i long"), "i")[1].first().n_violations == 0
    assert labels.merge_checked(df.distinct(), spark.createDataFrame([(0,)], "i long"), "i")[1].first().n_violations == 2


def test_episodes_and_windows_meet_once(spark):
    found = spark.createDataFrame([("a", at(0), at(5)), ("a", at(7), at(7, 1)), ("b", at(0), at(1))], "app_key string, start timestamp_ntz, end timestamp_ntz")
    windows = spark.createDataFrame([("a", "i", at(1), at(9)), ("a", "j", at(6), at(6, 5)), ("b", "k", at(1), at(1))], "app_key string, incident_id string, lo timestamp_ntz, hi timestamp_ntz")
    got = sorted((r.app_key, r.start, r.incident_id) for r in alerts.overlapping_episodes(found, windows).collect())
    assert got == [("a", at(0), "i"), ("a", at(7), "i"), ("b", at(0), "k")]


def test_penalties_with_many_topics_and_a_dependent_column(spark):
    rng = np.random.default_rng(8)
    n, vocabulary = 500, [f"t{i}" for i in range(70)]
    hit = rng.random((n, 3)) < .4
    y = rng.integers(1, 6, n).astype(float)
    reviews = spark.createDataFrame([(str(i), "app", dt.date(2024, 1, 3), int(i % 50 + 1), int(y[i])) for i in range(n)],
                                    "review_id string, app_key string, review_date date, text_length int, rating int")
    names = ["t1", "t69", "t5"]       # t5 and t6 always stand together
    rows = [(str(i), names[j]) for i in range(n) for j in range(3) if hit[i, j]] + [(str(i), "t6") for i in range(n) if hit[i, 2]]
    out = {r.topic: r for r in backlog.rating_penalties(backlog.review_cells(reviews, spark.createDataFrame(rows, "review_id string, topic string"), vocabulary), vocabulary).collect()}
    x = np.column_stack([np.ones(n), hit, hit[:, 2], np.log1p(np.arange(n) % 50 + 1)]).astype(float)
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    cov = inv @ (x.T * (y - x @ beta) ** 2) @ x @ inv * n / (n - 5)
    assert set(out) == {"t1", "t69", "t5", "t6"}
    for j, t in enumerate(("t1", "t69", "t5", "t6")):
        assert out[t].penalty == pytest.approx(beta[j + 1], abs=1e-8) and out[t].penalty_se == pytest.approx(math.sqrt(cov[j + 1, j + 1]), rel=1e-6)


def test_balanced_fit_matches_its_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(0, 1, 200) > .8).astype(float)
    df = classifiers.use_embeddings(spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "e array<double>, y double"), "e")
    model = classifiers.fit_binary(df, F.col("y"))
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    design, theta = np.column_stack([x, np.ones(200)]), np.zeros(3)
    for _ in range(100):   # Newton steps on sum w*loss + |b|^2/2, intercept unpenalised
        p = 1 / (1 + np.exp(-design @ theta))
        ridge = np.diag([1.0, 1.0, 0.0])
        theta -= np.linalg.solve((design.T * (w * p * (1 - p))) @ design + ridge, design.T @ (w * (p - y)) + ridge @ theta)
    coefficients, intercepts = model.theta()
    assert np.allclose([*coefficients[0], intercepts[0]], theta, atol=1e-9)
