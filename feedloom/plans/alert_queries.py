"""Early-warning queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import alerts
from feedloom.plans import fixtures as fx
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, ratio, relation, values
from feedloom.plans.registry import register
from feedloom.session import cut_lineage

_CASE = "case app_key " + " ".join(f"when '{a}' then {h}" for a, h in fx.BIN_HOURS.items()) + " else 3 end"


def _floor(ts: str, hours: str) -> str:
    return f"(timestamp '1970-01-01' + to_seconds((epoch(({ts}))::bigint // ({hours} * 3600)) * ({hours} * 3600)))"


relation("counted_bins", f"""
select app_key, bin_hours, {_floor("date_trunc('second', reviewed_at)", "bin_hours")} as bin_start, count(*) as n_reviews,
       count(*) filter (where rating <= 2) as n_negative
from (select *, {_CASE} as bin_hours from event_reviews) group by 1, 2, 3""")

relation("bins", """
select g.app_key, g.bin_hours, g.bin_start, coalesce(c.n_reviews, 0) as n_reviews, coalesce(c.n_negative, 0) as n_negative,
       cast(extract(hour from g.bin_start) as integer) as hour_of_day
from (select app_key, bin_hours, unnest(generate_series(min(bin_start), max(bin_start), to_hours(bin_hours))) as bin_start
      from counted_bins group by app_key, bin_hours) g
left join counted_bins c on c.app_key = g.app_key and c.bin_start = g.bin_start""")

relation("baselined", """
select *, case when len(hist) >= 5 then list_avg(hist) end as baseline_mean,
       case when len(hist) >= 5 then list_median(hist) end as baseline_median,
       case when len(hist) >= 5 then list_median(list_transform(hist, lambda x: abs(x - list_median(hist)))) end as baseline_mad
from (select * exclude (seen), list_slice(seen, greatest(len(seen) - 336 // bin_hours + 1, 1), len(seen)) as hist
      from (select *, coalesce(list(cast(n_negative as double)) over (partition by app_key, hour_of_day order by bin_start
                                   rows between 336 preceding and 1 preceding), []) as seen from bins))""")

relation("scored", """
select * exclude (hist), coalesce(poisson_p < cast(0.01 as double) and n_negative >= 3, false) as alert_poisson,
       coalesce(z > 3 and n_negative >= 3, false) as alert_zscore,
       coalesce(poisson_p < cast(0.01 as double) and n_negative >= 3, false) or coalesce(z > 3 and n_negative >= 3, false) as alert
from (select *, case when expected is not null then greatest(0, 1 - coalesce(list_sum(list_transform(range(0, n_negative),
                     lambda k: exp(k * ln(expected) - expected - lgamma(k + 1)))), 0)) end as poisson_p,
             (n_negative - baseline_median) / (1.4826 * baseline_mad + 1) as z
      from (select *, case when baseline_mean is not null then greatest(baseline_mean, 0.5) end as expected from baselined))""")

relation("found_episodes", """
select app_key, min(bin_start) as start_time, max(bin_start) as end_time, min(poisson_p) as peak_p
from (select *, sum(opens) over (partition by app_key order by bin_start rows unbounded preceding) as episode
      from (select *, case when lag(bin_start) over w is null or date_diff('second', lag(bin_start) over w, bin_start) / 3600.0 > 3 + bin_hours
                           then 1 else 0 end as opens
            from scored where alert window w as (partition by app_key order by bin_start)))
group by app_key, episode""")

relation("incident_log", "select incident_id, unnest(string_split(apps, ';')) as app_key, cast(s as timestamp) as start_time_ist, "
         "cast(r as timestamp) as first_public_report_ist from " + values([r[:4] for r in fx.INCIDENT_ROWS])
         + " as t(incident_id, apps, s, r)")


def _scored(s, d):
    # One row per app and bin, read by several later steps: worth a checkpoint,
    # which also keeps the detector expressions from being inlined into filters.
    return cut_lineage(alerts.scored_bins(fx.event_reviews(s, d), fx.BIN_HOURS))


_STATS = ("baseline_mean", "baseline_median", "baseline_mad", "expected", "poisson_p", "z")


def _r(*names: str) -> str:
    return ", ".join(f"{dec(n, 6)} as {n}" for n in names)


register("review_bins", lambda s, d: alerts.review_bins(fx.event_reviews(s, d), fx.BIN_HOURS), "select * from bins")

register("alert_detectors", lambda s, d: rounded(_scored(s, d), *_STATS), f"""
select app_key, bin_hours, bin_start, n_reviews, n_negative, hour_of_day, {_r(*_STATS)}, alert_poisson, alert_zscore, alert from scored""")

register("alert_episodes", lambda s, d: rounded(alerts.episodes(_scored(s, d)), "peak_p", digits=8), f"""
select app_key, start_time as "start", end_time as "end", {dec("peak_p", 8)} as peak_p from found_episodes""")


def _alert_rate(s, d):
    scored = _scored(s, d)
    return rounded(alerts.alert_rate(scored, alerts.episodes(scored)), "n_weeks", "events_per_week")


register("alert_rate", _alert_rate, f"""
select b.app_key, b.bin_hours, {dec("b.n_weeks", 6)} as n_weeks, coalesce(e.n_events, 0) as n_events,
       {dec(ratio("coalesce(e.n_events, 0)", "b.n_weeks"), 6)} as events_per_week
from (select app_key, bin_hours, floor(date_diff('second', min(bin_start), max(bin_start)) / 86400.0) / 7.0 as n_weeks from bins group by 1, 2) b
left join (select app_key, count(*) as n_events from found_episodes group by 1) e on b.app_key = e.app_key""")

register("incident_match", lambda s, d: rounded(
    alerts.match_incidents(_scored(s, d), fx.incidents(s), fx.BIN_HOURS), "expected", "poisson_p", "z", "lead_time_hours"), f"""
select incident_id, app_key, bin_start, bin_close, n_reviews, n_negative, {_r("expected", "poisson_p", "z")}, alert,
       {dec("case when alert then lead_hours end", 6)} as lead_time_hours,
       case when not alert then 'not matched' when lead_hours > 0 then 'beat the report' else 'lagged the report' end as verdict
from (select i.incident_id, s.*, s.bin_start + to_hours(s.bin_hours) as bin_close,
             date_diff('second', s.bin_start + to_hours(s.bin_hours), i.first_public_report_ist) / 3600.0 as lead_hours
      from incident_log i join scored s on i.app_key = s.app_key and s.bin_start <= i.start_time_ist
       and s.bin_start + to_hours(s.bin_hours) > i.start_time_ist)""")


def _near(hours: int) -> str:
    return f"""
select i.incident_id, s.app_key, s.bin_start, {dec("date_diff('second', i.start_time_ist, s.bin_start) / 3600.0", 6)} as hours_from_start,
       s.n_reviews, s.n_negative, {", ".join(f"{dec('s.' + n, 6)} as {n}" for n in ("expected", "poisson_p", "z"))}, s.alert
from incident_log i join scored s on i.app_key = s.app_key
 and s.bin_start between i.start_time_ist - interval {hours} hour and i.start_time_ist + interval {hours} hour"""


def _bins_near(hours: int):
    return lambda s, d: rounded(alerts.bins_near_incidents(_scored(s, d), fx.incidents(s), hours, fx.BIN_HOURS),
                                "hours_from_start", "expected", "poisson_p", "z")


register("incident_context", _bins_near(9), _near(9))
register("incident_timeline", _bins_near(24), _near(24))


def _overlap(s, d):
    windows = fx.incidents(s).select(
        "incident_id", "app_key", F.expr("timestampadd(HOUR, -48, start_time_ist)").alias("lo"),
        F.expr("timestampadd(HOUR, 48, start_time_ist)").alias("hi"))
    return rounded(alerts.overlapping_episodes(alerts.episodes(_scored(s, d)), windows), "peak_p", digits=8)


register("episode_overlap", _overlap, f"""
select e.app_key, e.start_time as "start", e.end_time as "end", {dec("e.peak_p", 8)} as peak_p, i.incident_id,
       i.start_time_ist - interval 48 hour as lo, i.start_time_ist + interval 48 hour as hi
from found_episodes e join incident_log i on i.app_key = e.app_key
where e.start_time <= i.start_time_ist + interval 48 hour and e.end_time >= i.start_time_ist - interval 48 hour""")

register("topic_share_alerts", lambda s, d: rounded(
    alerts.topic_share_bins(fx.event_reviews(s, d)), "baseline_share", "expected", "poisson_p"), f"""
with given as (select app_key, date_trunc('hour', reviewed_at) as bin_start, topic, count(*) as n from event_reviews group by 1, 2, 3),
     hourly as (select h.app_key, h.bin_start, t.topic, coalesce(g.n, 0) as topic_reviews
                from (select distinct app_key, bin_start from given) h join (select distinct app_key, topic from given) t on t.app_key = h.app_key
                left join given g on g.app_key = h.app_key and g.bin_start = h.bin_start and g.topic = t.topic),
     totals as (select *, cast(sum(topic_reviews) over (partition by app_key, bin_start) as bigint) as total_reviews from hourly),
     shares as (select *, {ratio("sum(topic_reviews) over w", "sum(total_reviews) over w")} as baseline_share from totals
                window w as (partition by app_key, topic order by bin_start
                             range between interval 14 day preceding and interval 1 second preceding)),
     rated as (select *, case when baseline_share is not null then greatest(total_reviews * baseline_share, 0.5) end as expected from shares),
     tested as (select *, case when expected is not null then greatest(0, 1 - coalesce(list_sum(list_transform(range(0, topic_reviews),
                          lambda k: exp(k * ln(expected) - expected - lgamma(k + 1)))), 0)) end as poisson_p from rated)
select app_key, bin_start, topic, topic_reviews, total_reviews, {_r("baseline_share", "expected", "poisson_p")},
       coalesce(poisson_p < cast(0.01 as double) and topic_reviews >= 3, false) as alert from tested""")

register("hour_of_week_alerts", lambda s, d: rounded(
    alerts.hour_of_week_bins(fx.event_reviews(s, d), fx.BIN_HOURS), "baseline_median", "baseline_mad", "z"), f"""
with seen as (select *, cast(extract(dow from bin_start) as integer) as day_of_week,
                     coalesce(list(cast(n_negative as double)) over (partition by app_key, extract(dow from bin_start), hour_of_day order by bin_start
                              rows between 4 preceding and 1 preceding), []) as hist from bins),
     base as (select *, case when len(hist) >= 2 then list_median(hist) end as baseline_median,
                     case when len(hist) >= 2 then list_median(list_transform(hist, lambda x: abs(x - list_median(hist)))) end as baseline_mad from seen),
     zs as (select *, (n_negative - baseline_median) / (1.4826 * baseline_mad + 1) as z from base)
select app_key, bin_hours, bin_start, n_reviews, n_negative, hour_of_day, day_of_week, {_r("baseline_median", "baseline_mad", "z")},
       coalesce(z > 3, false) as alert from zs""")

_CARD = ("event_recall", "alert_precision", "median_lead_hours")


def _scorecard(s, d):
    return rounded(alerts.scorecard(alerts.episodes(_scored(s, d)), fx.incidents(s), 48, 48), *_CARD)


register("alert_scorecard", _scorecard, f"""
with paired as (select e.app_key, e.start_time, i.incident_id, coalesce(e.start_time between i.start_time_ist - interval 48 hour
                       and i.start_time_ist + interval 48 hour, false) as inside,
                       date_diff('second', e.start_time, i.first_public_report_ist) / 3600.0 as lead_hours
                from found_episodes e left join incident_log i on e.app_key = i.app_key),
     per_episode as (select app_key, start_time, max(inside) as matched from paired group by 1, 2),
     caught as (select incident_id, max(lead_hours) as best from paired where inside group by 1),
     card as (select (select count(*) from per_episode) as n_episodes, (select count(*) from per_episode where matched) as n_matched,
                     (select count(*) from caught) as n_caught, (select median(best) from caught) as median_lead_hours,
                     (select count(distinct incident_id) from incident_log) as n_incidents)
select n_episodes, n_matched, n_caught, {dec("median_lead_hours", 6)} as median_lead_hours, n_incidents,
       {dec(ratio("n_caught", "n_incidents"), 6)} as event_recall, {dec(ratio("n_matched", "n_episodes"), 6)} as alert_precision from card""")

_SETTINGS = [(a, m, z) for a in (0.001, 0.01, 0.05) for m in (2, 3) for z in (2.0, 3.0)]

register("alert_threshold_sweep", lambda s, d: alerts.threshold_sweep(_scored(s, d), _SETTINGS)
         .groupBy("alpha", "min_count", "z_threshold", "app_key").agg(F.count(F.lit(1)).alias("n_events")), f"""
with spread as (select b.app_key, b.bin_start, b.bin_hours, p.alpha, p.min_count, p.z_threshold
                from scored b join {values(_SETTINGS)} as p(alpha, min_count, z_threshold)
                  on b.n_negative >= p.min_count and (b.poisson_p < cast(p.alpha as double) or b.z > p.z_threshold)),
     marked as (select *, case when lag(bin_start) over w is null or date_diff('second', lag(bin_start) over w, bin_start) / 3600.0 > 3 + bin_hours
                       then 1 else 0 end as opens from spread window w as (partition by alpha, min_count, z_threshold, app_key order by bin_start))
select cast(alpha as double) as alpha, min_count, cast(z_threshold as double) as z_threshold, app_key, cast(sum(opens) as bigint) as n_events
from marked group by 1, 2, 3, 4""")


def _operating_curve(s, d):
    return rounded(alerts.operating_curve(_scored(s, d), fx.incidents(s), _SETTINGS, 2.0, 48, 48), "recall", "false_per_app_week")


register("alert_operating_curve", _operating_curve, f"""
with settings as (select cast(alpha as double) as alpha, min_count, cast(z_threshold as double) as z_threshold from {values(_SETTINGS)} as p(alpha, min_count, z_threshold)),
     spread as (select b.app_key, b.bin_start, b.bin_hours, p.* from scored b join settings p on b.n_negative >= p.min_count and (b.poisson_p < p.alpha or b.z > p.z_threshold)),
     numbered as (select *, sum(opens) over (partition by alpha, min_count, z_threshold, app_key order by bin_start rows unbounded preceding) as episode from (
       select *, case when lag(bin_start) over w is null or date_diff('second', lag(bin_start) over w, bin_start) / 3600.0 > 3 + bin_hours then 1 else 0 end as opens
       from spread window w as (partition by alpha, min_count, z_threshold, app_key order by bin_start))),
     found as (select alpha, min_count, z_threshold, app_key, episode, min(bin_start) as start_time from numbered group by 1, 2, 3, 4, 5),
     pairs as (select f.*, i.incident_id from found f left join incident_log i on i.app_key = f.app_key
               and f.start_time between i.start_time_ist - interval 48 hour and i.start_time_ist + interval 48 hour),
     counted as (select alpha, min_count, z_threshold, count(*) as n_episodes, count(*) filter (where not matched) as n_false from (
       select alpha, min_count, z_threshold, app_key, episode, bool_or(incident_id is not null) as matched from pairs group by 1, 2, 3, 4, 5) group by 1, 2, 3),
     weeks as (select sum(w) as w from (select floor(date_diff('second', min(bin_start), max(bin_start)) / 86400.0) / 7.0 as w from bins group by app_key)),
     names as (select distinct incident_id from incident_log),
     cells as (select n.incident_id, s.*, coalesce(c.n_episodes, 0) as n_episodes, coalesce(c.n_false, 0) as n_false,
                      cast(exists (select 1 from pairs p where p.alpha = s.alpha and p.min_count = s.min_count and p.z_threshold = s.z_threshold and p.incident_id = n.incident_id) as integer) as hit
               from names n cross join settings s left join counted c on c.alpha = s.alpha and c.min_count = s.min_count and c.z_threshold = s.z_threshold),
     rated as (select *, sum(hit) over (partition by alpha, min_count, z_threshold) as n_caught, n_false / (select w from weeks) as rate from cells),
     ranked as (select *, row_number() over (partition by incident_id order by rate > 2, case when rate <= 2 then -(n_caught - hit) else 0 end, n_false, -(n_caught - hit), alpha, -min_count, -z_threshold) as own,
                       row_number() over (partition by incident_id order by rate > 2, case when rate <= 2 then -n_caught else 0 end, n_false, -n_caught, alpha, -min_count, -z_threshold) as overall from rated)
select alpha, min_count, z_threshold, n_episodes, n_false, cast(max(n_caught) as bigint) as n_caught, (select count(*) from names) as n_incidents, {dec("max(rate)", 6)} as false_per_app_week,
       bool_or(overall = 1) as chosen, count(*) filter (where own = 1) as n_chosen_without, count(*) filter (where own = 1 and hit = 1) as n_held_out_caught,
       {dec("max(n_caught) / cast((select count(*) from names) as double)", 6)} as recall
from ranked group by 1, 2, 3, 4, 5""")
