"""Brand-switching queries over the document texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from feedloom.functions.text import any_of
from feedloom.operators import staging, switching
from feedloom.plans import fixtures as fx
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, ratio, relation, sql_list, uniform, values
from feedloom.plans.registry import register
from feedloom.session import cut_lineage
from feedloom.sources import files


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MENTION = ", ".join(
    f"case when regexp_matches(lower(review_text), {_q(f'(^|[^a-z])(?:{any_of(v)})([^a-z]|$)')}) then {_q(app)} end"
    for app, v in fx.ALIASES.items())

relation("mention_rows", f"""
select *, list_filter([{_MENTION}], lambda x: x is not null and x <> app_key) as other_mentions from text_reviews""")


def _kind(app: str, variants: list[str]) -> str:
    arms = " ".join(f"when regexp_matches(review_text, {_q('(?i)' + switching.relation_regex(r, variants))}) then {_q(r)}"
                    for r in switching.RELATION_PATTERNS)
    return f"when {_q(app)} then case {arms} else 'none' end"


relation("relation_rows", f"""
select review_id, app_key, rating, review_date, other_app,
       case other_app {" ".join(_kind(a, v) for a, v in fx.ALIASES.items())} else 'none' end as relation
from (select *, unnest(other_mentions) as other_app from mention_rows where len(other_mentions) > 0)""")

relation("moves", """
select *, case when relation = 'switching_away' then app_key else other_app end as source,
       case when relation = 'switching_away' then other_app else app_key end as dest
from relation_rows where relation in ('switching_away', 'switched_from_competitor')""")

relation("text_totals", "select app_key, count(*) as n from text_reviews group by 1")

relation("flow_rows", f"""
select f.source, f.dest, f.n, t.n as source_total_reviews, {ratio("f.n", "t.n")} * 10000 as per_10k
from (select source, dest, count(*) as n from moves group by 1, 2) f left join text_totals t on f.source = t.app_key""")

# Binomial draws by inverse CDF: the number of j whose cumulative mass stays below u.
relation("flow_intervals", f"""
select source, dest, quantile_cont(rate, 0.025) as low, quantile_cont(rate, 0.975) as high
from (select f.source, f.dest, cast(len(list_filter(c.cdf, lambda m: m < {uniform(2026, "f.source", "f.dest", "r.run")})) as double) / f.total * 10000 as rate
      from (select source, dest, n as k, source_total_reviews as total from flow_rows where source_total_reviews is not null) f
      join (select k, total, list_transform(range(0, len(pmf)), lambda i: list_sum(pmf[1:i + 1])) as cdf
            from (select k, total, list_transform(range(0, least(total, k + 12 * cast(ceil(sqrt(k)) as bigint) + 40)), lambda j: exp(lgamma(total + 1) - lgamma(j + 1) - lgamma(total - j + 1)
                            + j * ln(k / cast(total as double)) + (total - j) * ln(1 - k / cast(total as double)))) as pmf
                  from (select distinct n as k, source_total_reviews as total from flow_rows where source_total_reviews is not null))) c
        on c.k = f.k and c.total = f.total, (select unnest(range(1, 1001)) as run) r)
group by 1, 2""")


def _candidates(s, d):
    return switching.mention_candidates(fx.text_reviews(s, d), fx.ALIASES)


def _relations(s, d):
    return switching.relations(_candidates(s, d), fx.ALIASES)


def _named(s, d):
    """Mentions and totals from one pass over the texts."""
    named = cut_lineage(switching.with_mentions(fx.text_reviews(s, d), fx.ALIASES))
    return switching.relations(switching.mention_candidates(named, fx.ALIASES), fx.ALIASES), named.groupBy("app_key").agg(F.count(F.lit(1)).alias("n"))


def _flows(s, d):
    # One row per pair of products, read two or three times by what follows.
    relations, totals = _named(s, d)
    return cut_lineage(switching.flow_counts(switching.flows(relations), totals))


def _monthly(s, d):
    relations, totals = _named(s, d)
    return switching.monthly_flows(cut_lineage(relations), fx.text_topics(s, d), totals, _GENERIC)


register("mention_candidates", lambda s, d: _candidates(s, d).drop("other_mentions", "review_text"), """
select review_id, app_key, rating, review_date, array_to_string(other_mentions, ';') as other_mentions_str,
       cast(len(other_mentions) as integer) as n_other_mentions from mention_rows where len(other_mentions) > 0""")

register("mention_counts", lambda s, d: switching.mention_counts(_candidates(s, d)), """
select other_app, count(*) as n from (select unnest(other_mentions) as other_app from mention_rows) group by 1""")

_ALIAS_FILE = Path(__file__).with_name("aliases.yaml")
_CONFIGURED = files.read_dictionary(str(_ALIAS_FILE))

register("configured_mentions", lambda s, d: switching.mention_counts(switching.mention_candidates(
    fx.text_reviews(s, d), files.read_dictionary(str(_ALIAS_FILE)))), f"""
select other_app, count(*) as n from (select unnest(other_mentions) as other_app from mention_rows)
where other_app in ({sql_list(list(_CONFIGURED))}) group by 1""")

register("candidate_share", lambda s, d: rounded(switching.candidate_share(fx.text_reviews(s, d), fx.ALIASES), "pct"), f"""
select app_key, count(*) as n_reviews, count(*) filter (where len(other_mentions) > 0) as n_candidates,
       {dec("100.0 * count(*) filter (where len(other_mentions) > 0) / count(*)", 6)} as pct from mention_rows group by 1""")

register("relations", _relations, "select * from relation_rows")

register("relation_crosstab", lambda s, d: switching.relation_crosstab(_relations(s, d)), """
select other_app, count(*) filter (where relation = 'switching_away') as switching_away,
       count(*) filter (where relation = 'switched_from_competitor') as switched_from_competitor,
       count(*) filter (where relation = 'comparison_only') as comparison_only, count(*) filter (where relation = 'none') as "none"
from relation_rows group by 1""")

register("switching_matrix", lambda s, d: rounded(
    staging.stage_switching(switching.bootstrap_ci(_flows(s, d))), "per_10k", "per_10k_ci_low", "per_10k_ci_high"), f"""
select f.source, f.dest, f.n, f.source_total_reviews, {dec("f.per_10k", 6)} as per_10k, {dec("i.low", 6)} as per_10k_ci_low, {dec("i.high", 6)} as per_10k_ci_high
from flow_rows f left join flow_intervals i on f.source = i.source and f.dest = i.dest""")

_PAIRS = values([(a, b) for i, a in enumerate(fx.BRANDS) for b in fx.BRANDS[i + 1:]])

register("net_flow", lambda s, d: rounded(switching.net_flow(_flows(s, d), fx.BRANDS), "a_to_b", "b_to_a", "net_per_10k"), f"""
select a, b, {dec("x", 6)} as a_to_b, {dec("y", 6)} as b_to_a, {dec("abs(x - y)", 6)} as net_per_10k,
       case when x - y > 0 then a || '->' || b else b || '->' || a end as direction
from (select a, b, coalesce((select sum(per_10k) from flow_rows where source = a and dest = b), 0) as x,
             coalesce((select sum(per_10k) from flow_rows where source = b and dest = a), 0) as y from {_PAIRS} as p(a, b))""")

register("flow_matrix", lambda s, d: rounded(switching.flow_matrix(_flows(s, d), fx.BRANDS), *fx.BRANDS), f"""
select a as source, {", ".join(f"{dec(f'case when a <> {_q(b)} then coalesce((select sum(per_10k) from flow_rows where source = a and dest = {_q(b)}), 0) end', 6)} as {b}" for b in fx.BRANDS)}
from {values([(b,) for b in fx.BRANDS])} as p(a)""")

_GENERIC = ["short_text", "long_text"]

register("flow_reasons", lambda s, d: switching.flow_reasons(_relations(s, d), fx.text_topics(s, d), _GENERIC), f"""
select source, dest, topic, n, cast(rk as integer) as "rank" from (
  select *, row_number() over (partition by source, dest order by n desc, topic) as rk from (
    select r.app_key as source, r.other_app as dest, t.topic, count(*) as n
    from relation_rows r join text_topics t on r.review_id = t.review_id
    where r.relation = 'switching_away' and t.topic not in ({sql_list(_GENERIC)}) group by 1, 2, 3))
where rk <= 6""")

register("monthly_flows", lambda s, d: rounded(_monthly(s, d), "per_10k"), f"""
with dated as (select *, strftime(review_date, '%Y-%m') as month from moves),
     reasons as (select d.month, d.source, d.dest, t.topic, count(*) as k from dated d join text_topics t on d.review_id = t.review_id
                 where t.topic not in ({sql_list(_GENERIC)}) group by 1, 2, 3, 4),
     best as (select *, row_number() over (partition by month, source, dest order by k desc, topic) as rk from reasons)
select c.month, c.source, c.dest, c.n, {dec(ratio("c.n", "t.n") + " * 10000", 6)} as per_10k, b.topic as top_reason
from (select month, source, dest, count(*) as n from dated group by 1, 2, 3) c
left join text_totals t on c.source = t.app_key
left join best b on b.month = c.month and b.source = c.source and b.dest = c.dest and b.rk = 1""")


def _net_inflow(s, d):
    apps = s.createDataFrame([(a,) for a in fx.ALIASES], "app_key string")
    return switching.net_inflow(_flows(s, d), apps)


register("net_inflow", _net_inflow, """
select coalesce(o.app_key, i.app_key) as app_key, cast(coalesce(o.n, 0) as bigint) as outflow, cast(coalesce(i.n, 0) as bigint) as inflow,
       cast(coalesce(i.n, 0) - coalesce(o.n, 0) as bigint) as net_inflow
from (select source as app_key, sum(n) as n from flow_rows group by 1) o
full join (select dest as app_key, sum(n) as n from flow_rows group by 1) i on o.app_key = i.app_key""")
