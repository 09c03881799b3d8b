"""Issue-cost and backlog queries over the review tables."""

from __future__ import annotations

from feedloom.operators import backlog, staging
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, digest, ratio, relation, sql_list, uniform, values
from feedloom.plans.registry import register
from feedloom.session import cut_lineage

_T = fx.ISSUE_TOPICS

# Long form of the design matrix: one row per review and non-zero regressor.
relation("design", f"""
select review_id, app_key, cast(rating as double) as y, 'intercept' as k, cast(1 as double) as x from stg_reviews
union all select review_id, app_key, rating, 'app=' || app_key, 1 from stg_reviews
union all select review_id, app_key, rating, 'month=' || strftime(review_date, '%Y-%m'), 1 from stg_reviews
union all select review_id, app_key, rating, 'log_len', ln(1 + text_length) from stg_reviews
union all select r.review_id, r.app_key, r.rating, 'topic=' || t.topic, 1
from stg_reviews r join (select distinct review_id, topic from raw_topics where topic in ({sql_list(_T)})) t on r.review_id = t.review_id""")


def _fit(prefix: str, source: str) -> None:
    """Relations of one least-squares fit: normal equations, Gauss-Jordan inverse, HC1."""
    relation(f"{prefix}_names", f"""
select k, row_number() over (order by k) as i from (
  select distinct k from {source}) where k <> (select min(k) from {source} where k like 'app=%') and k <> (select min(k) from {source} where k like 'month=%')""")
    relation(f"{prefix}_x", f"select d.review_id, d.y, n.i, d.x from {source} d join {prefix}_names n on d.k = n.k")
    relation(f"{prefix}_start", f"""
select list(cells order by i) as m from (
  select g.i, list(g.v order by g.j) || list_transform(range(1, (select count(*) from {prefix}_names) + 1), lambda c: case when c = g.i then cast(1 as double) else 0 end) as cells
  from (select a.i, b.i as j, coalesce(p.v, 0) as v from {prefix}_names a cross join {prefix}_names b
        left join (select a.i, b.i as j, sum(a.x * b.x) as v from {prefix}_x a join {prefix}_x b on a.review_id = b.review_id group by 1, 2) p
          on p.i = a.i and p.j = b.i) g group by g.i)""")
    relation(f"{prefix}_recursive_steps", f"""
select 1 as step, m from {prefix}_start
union all
select step + 1, list_transform(m, lambda r, q: case when q = step then p else list_transform(r, lambda v, c: v - r[step] * p[c]) end)
from (select step, m, list_transform(m[step], lambda v: v / m[step][step]) as p from {prefix}_recursive_steps where step <= len(m))""")
    relation(f"{prefix}_inverse", f"""
select i, j, m[i][len(m) + j] as v from (select m from {prefix}_recursive_steps where step = len(m) + 1),
     (select a.i, b.i as j from {prefix}_names a cross join {prefix}_names b)""")
    relation(f"{prefix}_beta", f"""
select v.i, sum(v.v * b.s) as b from {prefix}_inverse v join (select i, sum(x * y) as s from {prefix}_x group by i) b on v.j = b.i group by v.i""")
    relation(f"{prefix}_meat", f"""
select a.i, b.i as j, sum(e.ee * a.x * b.x) as v
from (select x.review_id, pow(max(x.y) - sum(x.x * b.b), 2) as ee from {prefix}_x x join {prefix}_beta b on x.i = b.i group by 1) e
join {prefix}_x a on a.review_id = e.review_id join {prefix}_x b on b.review_id = e.review_id group by 1, 2""")
    relation(f"{prefix}_penalties", f"""
select topic, penalty, se, penalty - 1.96 * se as low, penalty + 1.96 * se as high,
       greatest(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda q: (case when q in (0, 2000) then 1 when q % 2 = 1 then 4 else 2 end)
         * exp(-0.5 * pow(least(abs(penalty / se), 9) * q / 2000.0, 2)))) * least(abs(penalty / se), 9) / 6000.0 / sqrt(2 * pi())) as p
from (select substr(n.k, 7) as topic, b.b as penalty, sqrt(s.v * (select count(distinct review_id) from {source}) /
             ((select count(distinct review_id) from {source}) - (select count(*) from {prefix}_names))) as se
      from {prefix}_names n join {prefix}_beta b on n.i = b.i
      join (select l.i, sum(l.v * m.v * r.v) as v from {prefix}_inverse l join {prefix}_meat m on l.j = m.i
            join {prefix}_inverse r on r.i = m.j and r.j = l.i group by l.i) s on s.i = n.i
      where n.k like 'topic=%')""")


_fit("pooled", "design")
for _app in fx.APPS:
    relation(f"{_app}_design", f"select * from design where app_key = '{_app}'")
    _fit(_app, f"{_app}_design")

relation("recent", "select review_id, app_key from stg_reviews where review_date >= (select max(review_date) from stg_reviews) - 90")

relation("costs", f"""
select *, prevalence * abs(penalty) as rating_lift_if_fixed, prevalence * churn_intent_rate as churn_exposure
from (select t.app_key, p.topic, t.n as n_total_reviews_90d, coalesce(c.n, 0) as n_topic_reviews_90d, coalesce(c.churn, 0) as churn_intent_rate,
             {ratio("coalesce(c.n, 0)", "t.n")} as prevalence, p.penalty, p.low as penalty_ci_low, p.high as penalty_ci_high
      from (select app_key, count(*) as n from recent group by 1) t cross join pooled_penalties p
      left join (select r.app_key, m.topic, count(*) as n, avg(case when f.churn_intent then cast(1 as double) else 0 end) as churn
                 from recent r join (select distinct review_id, topic from raw_topics) m on r.review_id = m.review_id
                 left join raw_flags f on f.review_id = r.review_id group by 1, 2) c on c.app_key = t.app_key and c.topic = p.topic)""")


def _double(d: dict) -> str:
    return values([(k, float(v)) for k, v in d.items()])


relation("rice_rows", f"""
select *, reach * impact * confidence / effort_weeks as rice from (
  select c.*, cast(d.v as double) * prevalence as reach,
         cast(case when rating_lift_if_fixed >= 0.03 then 3 when rating_lift_if_fixed >= 0.015 then 2 when rating_lift_if_fixed >= 0.005 then 1
              when rating_lift_if_fixed >= 0.001 then 0.5 else 0.25 end as double) as impact,
         cast(case when coalesce(s.v, 0.4) >= 0.6 then 1 when coalesce(s.v, 0.4) >= 0.45 then 0.8 else 0.5 end as double) as confidence,
         cast(e.v as double) as effort_weeks
  from costs c left join {_double(fx.DOWNLOADS)} as d(k, v) on d.k = c.app_key
  left join {_double(fx.TOPIC_F1)} as s(k, v) on s.k = c.topic left join {_double(fx.EFFORT_WEEKS)} as e(k, v) on e.k = c.topic)""")

relation("stability", f"""
select app_key, topic, count(*) filter (where rk <= 3) / cast(1000 as double) * 100 as pct from (
  select app_key, topic, row_number() over (partition by app_key, run order by reach * impact * confidence / (effort_weeks * ({uniform(7, "app_key", "topic", "run")} + 0.5)) desc nulls last, topic) as rk
  from rice_rows, (select unnest(range(1, 1001)) as run))
group by 1, 2""")


class _Backlog:
    """Shared frames of the backlog queries; reviews are staged once, with the columns asked for."""

    def __init__(self, s, d, *extra):
        self.reviews = inputs.shared_reviews(s, d, "text_length", "rating", *extra)
        self.topics, self.flags = fx.raw_topics(s, d), fx.raw_flags(s, d)

    def costs(self):
        cells = backlog.review_cells(self.reviews, self.topics, _T)
        return backlog.issue_cost(self.reviews, self.topics, self.flags, backlog.rating_penalties(cells, _T))

    def scored(self):
        return cut_lineage(backlog.rice(self.costs(), fx.DOWNLOADS, fx.TOPIC_F1, fx.EFFORT_WEEKS))


def _cells(s, d):
    """Regression cells straight from the staged reviews, which the fit reads only once."""
    return backlog.review_cells(inputs.reviews(s, d), fx.raw_topics(s, d), _T)


_PENALTY = ("penalty", "penalty_se", "penalty_p", "penalty_ci_low", "penalty_ci_high")
_COST = ("prevalence", "churn_intent_rate", "penalty", "penalty_ci_low", "penalty_ci_high", "rating_lift_if_fixed", "churn_exposure")
_COST_SQL = "app_key, topic, n_topic_reviews_90d, n_total_reviews_90d, " + ", ".join(f"{dec(c, 6)} as {c}" for c in _COST)
_RICE = ("reach", "rice")
_RICE_SQL = _COST_SQL + ", impact, confidence, effort_weeks, " + ", ".join(f"{dec(c, 2)} as {c}" for c in _RICE)


def _rounded_rice(df):
    return rounded(rounded(df, *_COST), *_RICE, digits=2)


register("topic_wide", lambda s, d: backlog.topic_wide(inputs.reviews(s, d), fx.raw_topics(s, d), _T + ["unseen"]), f"""
select r.review_id, {", ".join(f"cast(coalesce(max(case when t.topic = '{t}' then 1 else 0 end), 0) as integer) as t_{t}" for t in _T + ["unseen"])}
from stg_reviews r left join raw_topics t on r.review_id = t.review_id group by 1""")


def _penalty_sql(prefix: str, extra: str = "") -> str:
    return (f"select {extra}topic, {dec('penalty', 6)} as penalty, {dec('se', 6)} as penalty_se, {dec('p', 6)} as penalty_p, "
            f"{dec('low', 6)} as penalty_ci_low, {dec('high', 6)} as penalty_ci_high from {prefix}_penalties")


register("rating_penalties", lambda s, d: rounded(
    backlog.rating_penalties(_cells(s, d), _T), *_PENALTY), _penalty_sql("pooled"))

register("app_rating_penalties", lambda s, d: rounded(
    backlog.rating_penalties(_cells(s, d), _T, by="app_key"), *_PENALTY),
    "\nunion all ".join(_penalty_sql(app, f"'{app}' as app_key, ") for app in fx.APPS))

register("issue_cost", lambda s, d: rounded(_Backlog(s, d).costs(), *_COST), f"select {_COST_SQL} from costs")

register("rice_backlog", lambda s, d: _rounded_rice(_Backlog(s, d).scored()), f"select {_RICE_SQL} from rice_rows")

register("top_issues", lambda s, d: _rounded_rice(backlog.top_issues(_Backlog(s, d).scored())), f"""
select {_RICE_SQL}, cast(rk as integer) as "rank" from (select *, row_number() over (partition by app_key order by rice desc, topic) as rk from rice_rows) where rk <= 5""")

register("rice_stability", lambda s, d: rounded(_rounded_rice(staging.stage_backlog(
    backlog.rice_stability(_Backlog(s, d).scored()), ("gear",))), "top3_stability_pct"), f"""
select r.*, {dec("s.pct", 6)} as top3_stability_pct, r.topic = 'gear' as needs_manual_review
from (select {_RICE_SQL} from rice_rows) r join stability s on s.app_key = r.app_key and s.topic = r.topic""")


def _issue_examples(s, d):
    shared = _Backlog(s, d, "review_hour")
    staged = staging.stage_topics(shared.topics, shared.reviews, ("rating",))
    return inputs.with_texts(s, d, backlog.issue_examples(staged, backlog.top_issues(shared.scored())))


register("issue_examples", _issue_examples, f"""
select app_key, topic, review_id, review_text from (
  select app_key, topic, review_id, review_text, row_number() over (partition by app_key, topic order by {digest(54, "review_id", "topic")}, review_id) as rk
  from (select distinct t.app_key, t.topic, t.review_id, t.review_text from stg_topics t
        join (select app_key, topic from (select *, row_number() over (partition by app_key order by rice desc, topic) as rk from rice_rows) where rk <= 5) i
          on i.app_key = t.app_key and i.topic = t.topic where t.rating <= 2))
where rk <= 2""")
