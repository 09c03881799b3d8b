"""Staging, marts and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import explore, marts, staging
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, digest, ratio
from feedloom.plans.registry import register
from feedloom.session import cut_lineage
from feedloom.sources import reviews as landing

# ---------------------------------------------------------------- staging

register("load_audit", lambda s, d: landing.load_audit(fx.raw_reviews(s, d)), f"""
select app_key, count(*) as n_rows, count(distinct review_key) as n_reviews, min(at_time) as first_review,
       max(at_time) as last_review,
       {dec("avg(case when version is null then cast(1 as double) else 0 end)", 3)} as missing_version_share
from raw_reviews group by app_key""")

register("stg_reviews", lambda s, d: inputs.reviews(s, d), "select * from stg_reviews")


def _pseudonymise(s, d):
    orders = fx.table(s, d, "orders")
    name = F.when(F.col("o_custkey") % 50 != 0, F.concat(F.lit("user "), F.col("o_custkey").cast("string")))
    pages = orders.select("o_orderkey", name.alias("userName"), F.lit("img").alias("userImage"))
    return landing.pseudonymise(pages)


register("pseudonymise", _pseudonymise, """
select o_orderkey, substr(sha256(coalesce(case when o_custkey % 50 <> 0 then 'user ' || cast(o_custkey as varchar) end, 'None')), 1, 16) as user_hash
from orders""")

register("stg_topics", lambda s, d: rounded(inputs.topics(s, d), "probability"), f"""
select review_id, app_key, review_date, review_hour, topic, {dec("probability", 6)} as probability from stg_topics""")

register("stg_flags", lambda s, d: rounded(
    staging.stage_flags(fx.raw_flags(s, d), inputs.shared_reviews(s, d)), "churn_probability"), f"""
select review_id, app_key, review_date, churn_intent, {dec("churn_probability", 6)} as churn_probability from stg_flags""")

# ---------------------------------------------------------------- marts

_DAILY_SQL = f"""
select app_key, review_date, n_reviews, {dec("avg_rating", 6)} as avg_rating, {dec("negative_share", 6)} as negative_share,
       {dec("avg_rating_7d", 6)} as avg_rating_7d, is_complete_day from daily"""

register("daily_app_metrics", lambda s, d: rounded(inputs.daily(s, d), "avg_rating", "negative_share", "avg_rating_7d"),
         _DAILY_SQL)

register("version_adoption", lambda s, d: inputs.adoption(s, d), "select * from adoption")

register("daily_topic_metrics", lambda s, d: inputs.topic_daily(s, d), "select * from topic_daily")

register("topic_quality_metrics", lambda s, d: rounded(
    cut_lineage(marts.topic_quality_metrics(inputs.topics(s, d, "rating"), fx.raw_flags(s, d))), "avg_rating_topic", "churn_intent_rate"), f"""
select t.app_key, t.review_date, t.topic, count(distinct t.review_id) as n_topic_reviews,
       {dec("avg(cast(t.rating as double))", 6)} as avg_rating_topic,
       {dec("avg(case when f.churn_intent then cast(1 as double) else 0 end)", 6)} as churn_intent_rate
from stg_topics t left join raw_flags f on t.review_id = f.review_id
group by t.app_key, t.review_date, t.topic""")

register("dim_date", lambda s, d: marts.dim_date(inputs.reviews(s, d)), """
select cast(d as date) as date, cast(extract(year from d) as integer) as year, cast(extract(month from d) as integer) as month,
       strftime(d, '%Y-%m') as year_month, cast(extract(dow from d) as integer) as day_of_week,
       extract(dow from d) in (0, 6) as is_weekend
from generate_series((select min(review_date) from stg_reviews), (select max(review_date) from stg_reviews), interval 1 day) as t(d)""")

register("review_samples", lambda s, d: inputs.with_texts(s, d, marts.review_samples(inputs.topics(s, d, "rating"))), f"""
select app_key, topic, year_month, review_id, rating, review_text, review_date from (
  select *, strftime(review_date, '%Y-%m') as year_month,
         row_number() over (partition by app_key, topic, strftime(review_date, '%Y-%m')
                            order by rating, {digest(8, "review_id", "topic")}, review_id) as rk
  from stg_topics)
where rk <= 8""")

# ---------------------------------------------------------------- exploration

register("top_weekly_risers", lambda s, d: explore.top_weekly_risers(*inputs.both_dailies(s, d)), f"""
select app_key, wk, topic, {dec("share", 4)} as share, {dec("change", 4)} as wow_change from (
  select *, row_number() over (partition by app_key order by change desc nulls last, topic) as rk from (
    select w.app_key, w.wk, w.topic, {ratio("w.n", "t.total")} as share,
           {ratio("w.n", "t.total")} - lag({ratio("w.n", "t.total")}) over (partition by w.app_key, w.topic order by w.wk) as change
    from (select app_key, topic, cast(date_trunc('week', review_date) as date) as wk, sum(n_topic_reviews) as n
          from topic_daily where is_complete_day group by 1, 2, 3) w
    join (select app_key, cast(date_trunc('week', review_date) as date) as wk, sum(n_reviews) as total
          from daily where is_complete_day group by 1, 2) t on w.app_key = t.app_key and w.wk = t.wk)
  where wk = (select max(cast(date_trunc('week', review_date) as date)) from topic_daily where is_complete_day))
where rk <= 3""")

register("rating_day_over_day", lambda s, d: rounded(
    explore.rating_day_over_day(inputs.daily(s, d)), "avg_rating", "avg_rating_7d"), f"""
select app_key, review_date, {dec("avg_rating", 6)} as avg_rating, {dec("avg_rating_7d", 6)} as avg_rating_7d,
       {dec("avg_rating - lag(avg_rating) over (partition by app_key order by review_date)", 3)} as day_over_day_delta
from daily where is_complete_day""")



def _length_sql(rel: str) -> str:
    return f"""
select app_key, {dec("median(text_length)", 6)} as median_len, {dec("quantile_cont(text_length, 0.90)", 6)} as p90_len,
       {dec("quantile_cont(text_length, 0.99)", 6)} as p99_len
from {rel} group by app_key"""


_LENGTHS = ("median_len", "p90_len", "p99_len")
register("length_percentiles", lambda s, d: rounded(explore.length_percentiles(inputs.reviews(s, d)), *_LENGTHS),
         _length_sql("stg_reviews"))
register("text_length_percentiles", lambda s, d: rounded(explore.length_percentiles(fx.text_reviews(s, d)), *_LENGTHS),
         _length_sql("text_reviews"))



def _sketch_errors(s, d):
    """Stored sketches per app and day, merged for the whole span and for the last 60 days, against exact ranks."""
    reviews = inputs.shared_reviews(s, d, "text_length")
    sketches = cut_lineage(explore.length_sketches(reviews))
    last = reviews.agg(F.max("review_date")).scalar()

    def spans(df):
        recent = F.col("review_date") > F.date_sub(last, 60)
        return df.withColumn("span", F.explode(F.array(F.lit("all"), F.when(recent, F.lit("last_60"))))).filter("span is not null")
    keys = ("app_key", "span")
    errors = explore.rank_errors(spans(reviews), explore.sketched_percentiles(spans(sketches), keys=keys), keys)
    return errors.select(*keys, "percentile", "n", (F.col("rank_error") <= 0.02).alias("within_bound"))


register("length_sketch_errors", _sketch_errors, """
select app_key, span, p as percentile, count(*) as n, true as within_bound
from (select app_key, 'all' as span from stg_reviews union all
      select app_key, 'last_60' from stg_reviews where review_date > (select max(review_date) from stg_reviews) - interval 60 day),
     (select cast(unnest([0.5, 0.9, 0.99]) as double) as p)
group by 1, 2, 3""")

register("text_snippets", lambda s, d: fx.text_reviews(s, d).select("review_id", text.snippet(F.col("review_text")).alias("snippet")), """
select review_id, replace(substr(review_text, 1, 140), chr(10), ' ') as snippet from text_reviews""")

register("first_topic_cohort", lambda s, d: cut_lineage(explore.first_topic_cohort(inputs.topics(s, d, "rating"))), f"""
select app_key, topic as first_topic, strftime(review_date, '%Y-%m') as cohort_month, count(distinct review_id) as n_reviewers,
       {dec("avg(cast(rating as double))", 2)} as avg_rating
from (select *, row_number() over (partition by review_id order by review_date, topic) as rn from stg_topics)
where rn = 1 group by 1, 2, 3""")

register("topic_cooccurrence", lambda s, d: cut_lineage(explore.topic_cooccurrence(inputs.topics(s, d), "widget")), f"""
select t.topic as co_occurring_topic, count(*) as n_co_occurrences,
       {dec("100.0 * count(*) / (select count(*) from stg_topics where topic = 'widget')", 2)} as pct_of_topic_reviews
from stg_topics t join (select review_id from stg_topics where topic = 'widget') a on t.review_id = a.review_id
where t.topic <> 'widget' group by 1""")

register("rating_distribution", lambda s, d: explore.rating_distribution(inputs.reviews(s, d)), f"""
select app_key, rating, count(*) as n, {dec("100.0 * count(*) / sum(count(*)) over (partition by app_key)", 1)} as pct
from stg_reviews group by app_key, rating""")

register("rating_by_app", lambda s, d: explore.rating_by_app(explore.rating_distribution(inputs.reviews(s, d)), fx.APPS), f"""
select rating, {", ".join(f"max(pct) filter (where app_key = '{a}') as {a}" for a in fx.APPS)} from (
  select app_key, rating, {dec("100.0 * count(*) / sum(count(*)) over (partition by app_key)", 1)} as pct
  from stg_reviews group by app_key, rating) group by rating""")

_TEXT_STATS_SQL = """
select app_key, {avg} as avg_chars, {med} as median_chars, {short} as pct_short from {rel} group by app_key"""


def _text_stats_sql(rel: str) -> str:
    return _TEXT_STATS_SQL.format(
        rel=rel, avg=dec("avg(text_length)", 1), med=dec("median(text_length)", 1),
        short=dec("100.0 * sum(case when len(string_split(review_text, ' ')) <= 5 then 1 else 0 end) / count(*)", 1))


register("text_stats", lambda s, d: explore.text_stats(inputs.reviews(s, d)), _text_stats_sql("stg_reviews"))
register("long_text_stats", lambda s, d: explore.text_stats(fx.text_reviews(s, d)), _text_stats_sql("text_reviews"))

register("word_histogram", lambda s, d: explore.word_histogram(fx.text_reviews(s, d)), """
select app_key, cast(least(len(string_split(review_text, ' ')), 41) as integer) as n_words, count(*) as n from text_reviews group by 1, 2""")

register("missing_version", lambda s, d: explore.missing_version(inputs.reviews(s, d)), f"""
select app_key, {dec("100.0 * avg(case when review_version is null then cast(1 as double) else 0 end)", 1)} as pct_missing_version
from stg_reviews group by app_key""")

register("hour_profile", lambda s, d: rounded(explore.hour_profile(fx.event_reviews(s, d)), "pct"), f"""
select app_key, cast(hr as integer) as hr, n, {dec("100.0 * n / sum(n) over (partition by app_key)", 6)} as pct from (
  select g.app_key, g.hr, coalesce(c.n, 0) as n
  from (select distinct app_key, unnest(range(0, 24)) as hr from event_reviews) g
  left join (select app_key, extract(hour from reviewed_at) as hr, count(*) as n from event_reviews group by 1, 2) c
    on g.app_key = c.app_key and g.hr = c.hr)""")

register("reply_profile", lambda s, d: explore.reply_profile(inputs.reviews(s, d)), f"""
select app_key, {dec("100.0 * avg(case when has_dev_reply then cast(1 as double) else 0 end)", 2)} as pct_replied,
       {dec("avg(case when has_dev_reply then cast(rating as double) end)", 2)} as avg_rating_replied,
       {dec("avg(case when not has_dev_reply then cast(rating as double) end)", 2)} as avg_rating_not_replied
from stg_reviews group by app_key""")

register("missing_days", lambda s, d: explore.missing_days(inputs.reviews(s, d)), """
select c.app_key, c.review_date from (
  select app_key, cast(unnest(generate_series(min(review_date), max(review_date), interval 1 day)) as date) as review_date
  from stg_reviews group by app_key) c
where not exists (select 1 from stg_reviews r where r.app_key = c.app_key and r.review_date = c.review_date)""")

register("coverage_audit", lambda s, d: explore.coverage_audit(inputs.reviews(s, d)), """
select app_key, min(review_date) as first_day, max(review_date) as last_day,
       cast(date_diff('day', min(review_date), max(review_date)) + 1 as integer) as n_days,
       date_diff('day', min(review_date), max(review_date)) + 1 - count(distinct review_date) as n_missing
from stg_reviews group by app_key""")

def _topic_prevalence(s, d):
    staged = inputs.shared_reviews(s, d, "review_hour")
    return cut_lineage(explore.topic_prevalence(staging.stage_topics(fx.raw_topics(s, d), staged), staged))


register("topic_prevalence", _topic_prevalence, f"""
select topic, count(*) as n, {dec("100.0 * count(*) / (select count(*) from stg_reviews)", 1)} as pct
from stg_topics group by topic""")

register("topic_coverage", lambda s, d: cut_lineage(explore.topic_coverage(inputs.topics(s, d))), """
select count(*) as n_pairs, count(distinct review_id) as n_reviews from stg_topics""")

register("marker_share", lambda s, d: explore.marker_share(fx.text_reviews(s, d), fx.MARKERS), f"""
select app_key, {dec(r"100.0 * sum(case when regexp_matches(lower(review_text), '\b(" + "|".join(fx.MARKERS) + r")\b') then 1 else 0 end) / count(*)", 1)} as pct_with_marker
from text_reviews group by app_key""")

register("spike_days", lambda s, d: rounded(explore.spike_days(inputs.daily(s, d), min_reviews=5), "negative_share"), f"""
select app_key, review_date, {dec("negative_share", 6)} as negative_share, n_reviews from daily
where negative_share > cast(0.30 as double) and n_reviews >= 5 and is_complete_day
order by daily.negative_share desc, app_key, review_date limit 15""")

register("mean_negative_share", lambda s, d: rounded(explore.mean_negative_share(inputs.daily(s, d)), "mean_negative_share"), f"""
select app_key, {dec("avg(negative_share)", 6)} as mean_negative_share from daily where is_complete_day group by app_key""")
