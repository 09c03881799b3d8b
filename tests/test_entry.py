"""The registered queries: contract, coverage of the SQL, and a run at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One query per family is compared here; the driver compares all of them.
COMPARED = ["stg_reviews", "daily_app_metrics", "first_topic_cohort", "alert_episodes", "relations", "stratified_sample", "label_agreement", "dq_report"]


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", COMPARED)
def test_result_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = contract.queries()[name](spark, sf_dir)
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, ([r[c] for c in names] for r in df.collect()))) == sorted(repr(list(r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["daily_app_metrics", "daily_topic_metrics", "review_samples", "topic_cooccurrence", "relations",
                                  "keyword_sample", "release_impact", "net_flow", "incident_match", "alert_scorecard", "episode_overlap",
                                  "rating_penalties", "topic_share_alerts"])
def test_plans_have_no_nested_loop_or_cartesian_join(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_top_k_queries_limit_rows_before_the_shuffle(spark, sf_dir):
    for name in ("stg_reviews", "keyword_sample"):
        assert "WindowGroupLimit" in contract.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_samples_shuffle_texts_of_chosen_reviews_only(spark, sf_dir):
    """The ranks work on ids: their plan, written before texts are joined, holds no text."""
    from feedloom.operators import marts
    from feedloom.plans import inputs

    plan = marts.review_samples(inputs.topics(spark, sf_dir, "rating"))._jdf.queryExecution().executedPlan().toString()
    assert "review_text" not in plan and "WindowGroupLimit" in plan


def test_counts_do_not_shuffle_texts(spark, sf_dir):
    df = contract.queries()["rating_distribution"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "review_text" not in plan.split("Exchange hashpartitioning(review_id")[0]
