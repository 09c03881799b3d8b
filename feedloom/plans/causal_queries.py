"""Release-impact queries over the review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import causal, explore, marts, staging
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, digest, ratio, relation
from feedloom.plans.registry import register
from feedloom.session import cut_lineage

_F, (_C1, _C2) = fx.FOCUS, fx.CONTROLS

relation("focus_span", f"""
select min(review_date) as min_d, max(review_date) as max_d from daily where app_key = '{_F}' and is_complete_day""")

relation("releases", f"""
select review_version as version, adoption_date, min_d, max_d,
       date_diff('day', greatest(cast(adoption_date - interval 21 day as date), min_d), least(cast(adoption_date - interval 1 day as date), max_d)) + 1 as pre_raw,
       date_diff('day', greatest(cast(adoption_date + interval 2 day as date), min_d), least(cast(adoption_date + interval 21 day as date), max_d)) + 1 as post_raw
from adoption, focus_span where app_key = '{_F}'""")

relation("placebo_draw", f"""
select version, event_date from (
  select version, event_date, row_number() over (partition by version order by {digest(2026, "version", "event_date")}, event_date) as rk
  from (select version, adoption_date, cast(unnest(generate_series(min_d + interval 21 day, max_d - interval 21 day, interval 1 day)) as date) as event_date
        from releases where pre_raw >= 7 and post_raw >= 7)
  where abs(date_diff('day', adoption_date, event_date)) > 21)
where rk <= 150""")

# Fixed effects by explicit demeaning within the day, then Cramer's rule on the
# weighted 3x3 normal equations of (treated:post, first control, second control).
relation("effects", f"""
select event_date,
       case when n_pre >= 3 and n_post >= 3 and c_pre > 0 and c_post > 0 and abs(det) > 1e-12 then
         (bx * (g11 * g22 - g12 * g12) - gx1 * (b1 * g22 - g12 * b2) + gx2 * (b1 * g12 - g11 * b2)) / det end as effect
from (select *, gxx * (g11 * g22 - g12 * g12) - gx1 * (gx1 * g22 - g12 * gx2) + gx2 * (gx1 * g12 - g11 * gx2) as det
      from (select event_date, sum(w * dx * dx) as gxx, sum(w * dx * d1) as gx1, sum(w * dx * d2) as gx2, sum(w * d1 * d1) as g11,
                   sum(w * d1 * d2) as g12, sum(w * d2 * d2) as g22, sum(w * dx * dy) as bx, sum(w * d1 * dy) as b1, sum(w * d2 * dy) as b2,
                   count(*) filter (where app_key = '{_F}' and not post) as n_pre, count(*) filter (where app_key = '{_F}' and post) as n_post,
                   count(*) filter (where app_key <> '{_F}' and not post) as c_pre, count(*) filter (where app_key <> '{_F}' and post) as c_post
            from (select *, x - sum(w * x) over day / sum(w) over day as dx, c1 - sum(w * c1) over day / sum(w) over day as d1,
                         c2 - sum(w * c2) over day / sum(w) over day as d2, y - sum(w * y) over day / sum(w) over day as dy
                  from (select e.event_date, p.app_key, p.review_date, p.review_date > e.event_date as post, cast(p.n_reviews as double) as w,
                               p.negative_share as y, case when p.app_key = '{_F}' and p.review_date > e.event_date then cast(1 as double) else 0 end as x,
                               case when p.app_key = '{_C1}' then cast(1 as double) else 0 end as c1,
                               case when p.app_key = '{_C2}' then cast(1 as double) else 0 end as c2
                        from (select adoption_date as event_date from releases union select event_date from placebo_draw) e
                        join daily p on p.is_complete_day
                         and (p.review_date between e.event_date - interval 21 day and e.event_date - interval 1 day
                              or p.review_date between e.event_date + interval 2 day and e.event_date + interval 21 day))
                  window day as (partition by event_date, review_date))
            group by event_date))""")

relation("placebo_found", "select d.version, d.event_date, e.effect from placebo_draw d join effects e on d.event_date = e.event_date where e.effect is not null")

relation("impact", """
select r.version, r.adoption_date, greatest(r.pre_raw, 0) as n_pre_days, greatest(r.post_raw, 0) as n_post_days,
       coalesce(r.real_effect is not null and n.n >= 20, false) as usable, r.real_effect,
       case when r.real_effect is not null then coalesce(n.n, 0) else 0 end as n_placebo,
       case when r.real_effect is not null and n.n >= 20 then (n.extreme + 1.0) / (n.n + 1.0) end as placebo_p,
       case when r.real_effect is not null and n.n >= 20 and n.sd > 0 then r.real_effect / n.sd end as health_score
from (select r.*, case when r.pre_raw >= 7 and r.post_raw >= 7 then e.effect end as real_effect from releases r left join effects e on r.adoption_date = e.event_date) r
left join (select p.version, count(*) as n, count(*) filter (where abs(p.effect) >= abs(e.effect)) as extreme, stddev_pop(p.effect) as sd
           from placebo_found p join releases r on p.version = r.version left join effects e on e.event_date = r.adoption_date group by 1) n
  on r.version = n.version""")

relation("impact_q", """
select i.*, q.q_value, coalesce(q.q_value <= 0.10, false) as is_significant from impact i left join (
  select version, least(1, min(placebo_p * m / rk) over (order by rk desc rows unbounded preceding)) as q_value
  from (select version, placebo_p, row_number() over (order by placebo_p, version) as rk, count(*) over () as m
        from impact where placebo_p is not null)) q on i.version = q.version""")


class _Study:
    """The frames all release queries share; one pass over the reviews feeds them."""

    def __init__(self, s, d, reviews=None):
        self.reviews = inputs.reviews(s, d) if reviews is None else reviews
        self.cells = cut_lineage(marts.day_cells(self.reviews))
        self.daily = marts.daily_from_cells(self.cells)
        self.adoption = marts.adoption_from_cells(self.cells)
        self.windows = causal.release_windows(self.daily, self.adoption, _F)

    def tested(self):
        placebos = causal.placebo_dates(self.windows)
        effects = cut_lineage(causal.did_effects(
            self.daily, causal.candidate_dates(self.windows, placebos), _F, fx.CONTROLS))
        return effects, causal.placebo_effects(effects, placebos)

    def impact(self):
        effects, placebo = self.tested()
        return staging.stage_release_impact(causal.release_impact(self.windows, effects, placebo))


register("did_effects", lambda s, d: rounded(_Study(s, d).tested()[0], "effect"), f"""
select event_date, {dec("effect", 6)} as effect from effects
where event_date in (select adoption_date from releases where pre_raw >= 7 and post_raw >= 7 union select event_date from placebo_draw)""")

register("release_windows", lambda s, d: _Study(s, d).windows.select(
    "version", "adoption_date", "n_pre_days", "n_post_days", "testable"), """
select version, adoption_date, cast(greatest(pre_raw, 0) as integer) as n_pre_days, cast(greatest(post_raw, 0) as integer) as n_post_days,
       pre_raw >= 7 and post_raw >= 7 as testable from releases""")

register("placebo_dates", lambda s, d: causal.placebo_dates(_Study(s, d).windows).select("version", "event_date"),
         "select version, event_date from placebo_draw")

_IMPACT = ("real_effect", "placebo_p", "q_value", "health_score")

register("release_impact", lambda s, d: rounded(_Study(s, d).impact(), *_IMPACT), f"""
select '{_F}' as app_key, version, adoption_date, cast(n_pre_days as integer) as n_pre_days, cast(n_post_days as integer) as n_post_days,
       usable, {", ".join(f"{dec(c, 6)} as {c}" for c in _IMPACT)}, n_placebo, is_significant from impact_q""")

register("impact_leaderboard", lambda s, d: explore.impact_leaderboard(_Study(s, d).impact()), f"""
select version, adoption_date, {dec("real_effect", 4)} as real_effect, {dec("health_score", 2)} as health_score, {dec("q_value", 3)} as q_value,
       is_significant, usable, cast(rank() over (order by abs(health_score) desc nulls last) as integer) as rank_by_abs_health_score
from impact_q""")


def _dim_version(s, d):
    study = _Study(s, d)
    return rounded(marts.dim_version(study.adoption, study.impact()), "real_effect", "q_value")


register("dim_version", _dim_version, f"""
select v.app_key, v.review_version, v.adoption_date, v.total_reviews, i.usable as impact_analysis_usable,
       {dec("i.real_effect", 6)} as real_effect, {dec("i.q_value", 6)} as q_value, i.is_significant
from adoption v left join impact_q i on v.app_key = '{_F}' and v.review_version = i.version""")

register("placebo_histogram", lambda s, d: causal.placebo_histogram(_Study(s, d).tested()[1]), """
select p.version, case when hi > lo then least(cast(floor((effect - lo) / (hi - lo) * 25) as integer), 24) else 12 end as bin, count(*) as n
from placebo_found p join (select version, min(effect) as lo, max(effect) as hi from placebo_found group by 1) r on p.version = r.version
group by 1, 2""")


def _event_study(s, d):
    study = _Study(s, d)
    return rounded(causal.event_study(study.daily, study.windows), "negative_share")


register("event_study", _event_study, f"""
select r.version, r.adoption_date, p.app_key, p.review_date, cast(date_diff('day', r.adoption_date, p.review_date) as integer) as relative_day,
       {dec("p.negative_share", 6)} as negative_share
from releases r join daily p on p.is_complete_day and p.review_date between r.adoption_date - interval 21 day and r.adoption_date + interval 21 day""")


def _topic_shift(s, d):
    staged = inputs.shared_reviews(s, d, "review_hour", "review_version", "rating", "is_negative")
    study = _Study(s, d, staged)
    topics = staging.stage_topics(staging.topic_counts(fx.raw_topics(s, d)), staged)
    # read for the topics' counts and for the days' volumes
    topic_daily = cut_lineage(marts.daily_topic_metrics(topics, study.daily))
    return rounded(causal.topic_shift(topic_daily, study.windows, _F), "pre_share", "post_share", "change_pp")


register("topic_shift", _topic_shift, f"""
with own as (select r.version, p.review_date, p.review_date > r.adoption_date as post, p.topic, p.n_topic_reviews, p.n_reviews_that_day
             from releases r join topic_daily p on p.app_key = '{_F}' and p.is_complete_day
              and (p.review_date between r.adoption_date - interval 21 day and r.adoption_date - interval 1 day
                   or p.review_date between r.adoption_date + interval 2 day and r.adoption_date + interval 21 day)),
     volume as (select version, post, sum(n) as n from (select distinct version, post, review_date, n_reviews_that_day as n from own) group by 1, 2),
     part as (select o.version, o.topic, o.post, sum(o.n_topic_reviews) / cast(max(v.n) as double) as share
              from own o join volume v on o.version = v.version and o.post = v.post group by 1, 2, 3),
     wide as (select version, topic, coalesce(max(share) filter (where not post), 0) as pre_share, coalesce(max(share) filter (where post), 0) as post_share
              from part group by 1, 2)
select version, topic, {dec("pre_share", 6)} as pre_share, {dec("post_share", 6)} as post_share, {dec("(post_share - pre_share) * 100", 6)} as change_pp from wide""")


def _rollout(s, d):
    study = _Study(s, d)
    return rounded(causal.rollout_overlap(study.cells, study.adoption, _F), "mean_new", "mean_old", "effect", "se", "p_value")


# The t tail comes from numeric integration of cos^(dof-1), Simpson's rule.
_SIMPSON = """list_sum(list_transform(range(0, 4001), lambda k: (case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end)
      * pow(cos({lo} + ({hi} - {lo}) * k / 4000.0), dof - 1))) * ({hi} - {lo}) / 12000.0"""

register("rollout_overlap", _rollout, f"""
with ordered as (select r.version, r.adoption_date, (select arg_max(p.version, (p.adoption_date, p.version)) from releases p where p.adoption_date < r.adoption_date) as prior_version from releases r),
     picked as (select o.version, o.prior_version, s.review_date, cast(s.rating as double) as y, case when s.review_version = o.version then cast(1 as double) else 0 end as x
                from ordered o join stg_reviews s on s.app_key = '{_F}' and s.review_version in (o.version, o.prior_version)
                 and s.review_date between o.adoption_date - interval 3 day and o.adoption_date + interval 10 day
                where o.prior_version is not null),
     centred as (select *, x - avg(x) over (partition by version, review_date) as dx, y - avg(y) over (partition by version, review_date) as dy from picked),
     fitted as (select version, prior_version, count(*) filter (where x = 1) as n_new, count(*) filter (where x = 0) as n_old, avg(y) filter (where x = 1) as mean_new,
                       avg(y) filter (where x = 0) as mean_old, sum(dx * dx) as xx, sum(dx * dy) as xy, sum(dy * dy) as yy,
                       count(*) - count(distinct review_date) - 1.0 as dof from centred group by 1, 2),
     tested as (select *, xy / xx as effect, sqrt((yy - xy / xx * xy) / dof / xx) as se from fitted where n_new > 0 and n_old > 0),
     angled as (select *, atan(abs(effect / se) / sqrt(dof)) as theta, least(pi() / 2, 12 / sqrt(dof)) as top from tested)
select version, prior_version, n_new, n_old, {dec("mean_new", 6)} as mean_new, {dec("mean_old", 6)} as mean_old, {dec("effect", 6)} as effect, {dec("se", 6)} as se,
       {dec("(" + _SIMPSON.format(lo="theta", hi="greatest(top, theta)") + ") / (" + _SIMPSON.format(lo="cast(0 as double)", hi="top") + ")", 6)} as p_value
from angled""")
