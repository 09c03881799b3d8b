"""Quality reports, dashboard measures and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import alerts, backlog, marts, measures, staging
from feedloom.plans import backlog_queries, causal_queries
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, ratio, values
from feedloom.plans.registry import register
from feedloom.session import cut_lineage, scratch_path
from feedloom.sources import files
from feedloom.sources import reviews as landing

# ---------------------------------------------------------------- measures

_W = "sum({v} * n_reviews) / sum(n_reviews)"
register("kpi_overview", lambda s, d: rounded(measures.overview(inputs.daily(s, d), "app_key"), "avg_rating", "negative_share"), f"""
select app_key, cast(sum(n_reviews) as bigint) as total_reviews, {dec(_W.format(v="avg_rating"), 6)} as avg_rating,
       {dec(_W.format(v="negative_share"), 6)} as negative_share from daily group by app_key""")

_TREND = ("avg_rating_30d", "avg_rating_prior_30d", "rating_delta_30d")
register("kpi_30d", lambda s, d: rounded(measures.rating_trend(cut_lineage(inputs.daily(s, d))), *_TREND), f"""
select app_key, {dec("a", 6)} as avg_rating_30d, {dec("b", 6)} as avg_rating_prior_30d, {dec("a - b", 6)} as rating_delta_30d from (
  select app_key, sum(avg_rating * n_reviews) filter (where age < 30) / sum(n_reviews) filter (where age < 30) as a,
         sum(avg_rating * n_reviews) filter (where age between 30 and 59) / sum(n_reviews) filter (where age between 30 and 59) as b
  from (select *, date_diff('day', review_date, (select max(review_date) from daily)) as age from daily) group by 1)""")

register("topic_share_measure", lambda s, d: rounded(
    measures.topic_share(*inputs.both_dailies(s, d)), "topic_share"), f"""
select t.app_key, t.topic, t.topic_reviews, a.total_reviews, {dec(ratio("t.topic_reviews", "a.total_reviews"), 6)} as topic_share
from (select app_key, topic, cast(sum(n_topic_reviews) as bigint) as topic_reviews from topic_daily group by 1, 2) t
join (select app_key, cast(sum(n_reviews) as bigint) as total_reviews from daily group by 1) a on a.app_key = t.app_key""")


def _category_share(s, d):
    return rounded(measures.category_share(
        *inputs.both_dailies(s, d), marts.dim_app(s, fx.DIM_APP_ROWS),
        marts.dim_topic(s, fx.DIM_TOPIC_ROWS)), "share")


register("category_share", _category_share, f"""
select t.app_key, c.category, c.actionable as is_actionable_issue, cast(sum(t.n_topic_reviews) as bigint) as topic_reviews, a.total_reviews,
       n.display_name, n.is_focus_app, {dec(ratio("sum(t.n_topic_reviews)", "a.total_reviews"), 6)} as share
from topic_daily t join {values(fx.DIM_TOPIC_ROWS)} as c(topic_key, display_name, category, actionable) on c.topic_key = t.topic
join (select app_key, cast(sum(n_reviews) as bigint) as total_reviews from daily group by 1) a on a.app_key = t.app_key
join {values([r[:3] for r in fx.DIM_APP_ROWS])} as n(app_key, display_name, is_focus_app) on n.app_key = t.app_key
group by 1, 2, 3, 5, 6, 7""")


def _release_counts(s, d):
    study = causal_queries._Study(s, d)
    return measures.release_counts(marts.dim_version(study.adoption, study.impact()))


register("release_counts", _release_counts, f"""
select v.app_key, count(*) as n_releases, count(*) filter (where i.usable) as usable_releases,
       count(*) filter (where i.is_significant) as significant_releases
from adoption v left join impact_q i on v.app_key = '{fx.FOCUS}' and v.review_version = i.version group by 1""")


def _alert_measures(s, d):
    scored = cut_lineage(alerts.scored_bins(fx.event_reviews(s, d), fx.BIN_HOURS))
    return rounded(measures.alert_measures(staging.stage_alerts(alerts.episodes(scored))), "alert_duration_hours")


register("alert_measures", _alert_measures, f"""
select app_key, count(*) as alert_events, {dec("avg(cast(date_diff('hour', start_time, end_time) as double))", 6)} as alert_duration_hours
from found_episodes group by 1""")


def _stability(s, d):
    scored = backlog_queries._Backlog(s, d).scored()
    return rounded(measures.mean_stability(backlog.rice_stability(scored)), "top3_stability")


register("stability_measure", _stability, f"select app_key, {dec('avg(pct)', 6)} as top3_stability from stability group by 1")

# ---------------------------------------------------------------- files


def _csv_round_trip(s, d):
    """Daily mart exported as CSV and read back with its schema."""
    daily = rounded(inputs.daily(s, d), "avg_rating", "negative_share", "avg_rating_7d")
    folder = scratch_path(s, "export")
    files.export_csv({"fct_daily_app_metrics": daily}, folder, {"fct_daily_app_metrics": ["app_key", "review_date"]})
    schema = ", ".join(f"{n} {t}" for n, t in daily.dtypes)
    return files.read_csv(s, f"{folder}/fct_daily_app_metrics", schema)


register("csv_round_trip", _csv_round_trip, f"""
select app_key, review_date, n_reviews, {dec("avg_rating", 6)} as avg_rating, {dec("negative_share", 6)} as negative_share,
       {dec("avg_rating_7d", 6)} as avg_rating_7d, is_complete_day from daily""")


def _landing_round_trip(s, d):
    """Two landings with different columns, read back united by name."""
    raw = fx.raw_reviews(s, d)
    path = scratch_path(s, "landing")
    landing.append_pages(raw.filter(F.col("app_key") == fx.FOCUS), path)
    landing.append_pages(raw.filter(F.col("app_key") != fx.FOCUS).drop("replyContent"), path)
    return landing.read_pages(s, path).groupBy("app_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("replyContent").alias("n_replies"),
        F.max("scraped_at").alias("last_scrape"))


register("landing_round_trip", _landing_round_trip, f"""
select app_key, count(*) as n_rows, count(case when app_key = '{fx.FOCUS}' then reply end) as n_replies, max(scraped_at) as last_scrape
from raw_reviews group by 1""")
