"""SQL statements of the adapters and the shared relations, for the result check.

`statement` prefixes a body with exactly the common table expressions it names.
"""

from __future__ import annotations

import re

from feedloom.plans import fixtures as fx


def dec(expr: str, digits: int) -> str:
    """Half-up rounding in decimal arithmetic, returned as double."""
    return f"cast(round(cast(({expr}) as decimal(38,10)), {digits}) as double)"


def ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def uniform(seed, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496.0)"


def digest(seed, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def values(rows) -> str:
    def cell(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return "null" if v is None else repr(v)
    return "(values " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def sql_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


RELATIONS: dict[str, str] = {}
MATERIALIZED: set[str] = set()


def relation(name: str, sql: str, materialized: bool = False) -> None:
    RELATIONS[name] = sql.strip()
    if materialized:
        MATERIALIZED.add(name)


def statement(body: str) -> str:
    """Body preceded by the relations it needs, in dependency order."""
    order: list[str] = []

    def add_dependencies(sql: str, own: str = "") -> None:
        for name in RELATIONS:
            if name != own and name not in order and re.search(rf"\b{name}\b", sql):
                add_dependencies(RELATIONS[name], name)
                order.append(name)

    add_dependencies(body)
    if not order:
        return body.strip()
    own = body.strip()
    own = ",\n" + own[5:] if own.startswith("with ") else "\n" + own
    recursive = "recursive " if any(n.endswith("recursive_steps") for n in order) else ""
    return f"with {recursive}" + ",\n".join(f"{n} as {'materialized ' * (n in MATERIALIZED)}(\n{RELATIONS[n]}\n)" for n in order) + own


relation("raw_reviews", """
select cast(l_orderkey * 10 + l_linenumber as varchar) as review_key,
       case when l_partkey % 97 = 0 then '   ' when l_partkey % 89 = 0 then null else ' ' || p_name || ' ' end as content,
       cast(floor((l_quantity - 1) / 10) + 1 as integer) as score,
       l_linenumber as thumbs,
       case when l_suppkey % 10 <> 0 then 'v' || cast((date_diff('day', date '1995-01-01', cast(l_shipdate as date)) - l_partkey % 20 + 60) // 60 as varchar) end as version,
       l_shipdate + to_hours(cast(l_partkey % 24 as integer)) as at_time,
       case when l_linestatus = 'F' then 'reply' end as reply,
       substr(sha256('user' || cast(l_suppkey as varchar)), 1, 16) as user_hash,
       'app_' || lower(l_returnflag) as app_key,
       l_shipdate + to_hours(cast(l_partkey % 24 as integer)) + to_days(l_linenumber) as scraped_at
from lineitem join part on l_partkey = p_partkey""")

relation("stg_reviews", """
select review_key as review_id, app_key, user_hash, trim(content) as review_text, score as rating,
       thumbs as thumbs_up, version as review_version, at_time as reviewed_at,
       cast(at_time as date) as review_date, cast(date_trunc('hour', at_time) as timestamp) as review_hour,
       reply is not null as has_dev_reply, cast(length(trim(content)) as integer) as text_length,
       score <= 2 as is_negative, scraped_at
from (select *, row_number() over (partition by review_key order by scraped_at desc nulls last,
             at_time desc nulls last, score desc nulls last, thumbs desc nulls last, app_key desc nulls last,
             version desc nulls last) as copy_no
      from raw_reviews)
where copy_no = 1 and content is not null and length(trim(content)) > 0""")

relation("raw_topics", """
select cast(l_orderkey * 10 + l_linenumber as varchar) as review_id, lower(p_type) as topic, cast(0.9 as double) as probability
from lineitem join part on l_partkey = p_partkey
union all
select cast(l_orderkey * 10 + l_linenumber as varchar), split_part(p_name, ' ', 2), l_tax + cast(0.5 as double)
from lineitem join part on l_partkey = p_partkey""")

relation("stg_topics", """
select t.review_id, r.app_key, r.review_date, r.review_hour, t.topic, t.probability, r.rating, r.review_text
from raw_topics t join stg_reviews r on t.review_id = r.review_id""")

relation("raw_flags", """
select cast(l_orderkey * 10 + l_linenumber as varchar) as review_id,
       max(l_discount) >= cast(0.09 as double) as churn_intent, max(l_discount) * 10 as churn_probability
from lineitem group by 1""")

relation("stg_flags", """
select f.review_id, r.app_key, r.review_date, f.churn_intent, f.churn_probability
from raw_flags f join stg_reviews r on f.review_id = r.review_id""")

relation("daily", """
select app_key, review_date, count(*) as n_reviews, avg(cast(rating as double)) as avg_rating,
       avg(case when is_negative then cast(1 as double) else 0 end) as negative_share,
       avg(avg(cast(rating as double))) over (partition by app_key order by review_date rows between 6 preceding and current row) as avg_rating_7d,
       review_date <= cast(max(review_date) over (partition by app_key) - interval 2 day as date) as is_complete_day
from stg_reviews group by app_key, review_date""")

relation("topic_daily", f"""
select t.app_key, t.review_date, t.topic, count(distinct t.review_id) as n_topic_reviews,
       d.n_reviews as n_reviews_that_day,
       {dec(ratio("count(distinct t.review_id)", "d.n_reviews"), 4)} as topic_share, d.is_complete_day
from stg_topics t join daily d on t.app_key = d.app_key and t.review_date = d.review_date
group by t.app_key, t.review_date, t.topic, d.n_reviews, d.is_complete_day""")

relation("adoption", """
select * from (
  select app_key, review_version, min(review_date) filter (where version_share >= cast(0.05 as double)) as adoption_date,
         min(review_date) as first_seen_date, cast(sum(n) as bigint) as total_reviews
  from (select *, cast(n as double) / sum(n) over (partition by app_key, review_date) as version_share
        from (select r.app_key, r.review_date, r.review_version, count(*) as n
              from stg_reviews r
              join (select app_key, max(review_date) as last_date from stg_reviews group by 1) c on r.app_key = c.app_key
              where r.review_version is not null and r.review_date <= cast(c.last_date - interval 2 day as date)
              group by 1, 2, 3))
  group by 1, 2)
where adoption_date is not null and total_reviews >= 200""")

relation("event_reviews", """
select cast(event_id as varchar) as review_id, 'app_' || cast(user_id % 3 as varchar) as app_key, ts as reviewed_at,
       case event_type when 'error' then 1 when 'view' then 3 when 'click' then 4 else 5 end as rating, event_type as topic
from events""")

_remarks = "[" + sql_list(fx.REMARKS) + "]"
_remark = f"case when (doc_id // 3) % 4 = 0 then {_remarks}[cast((doc_id // 12) % 12 + 1 as integer)] else '' end"
_brands = "[" + sql_list(fx.BRANDS) + "]"
relation("text_reviews", f"""
select cast(doc_id as varchar) as review_id, {_brands}[cast(doc_id % 3 + 1 as integer)] as app_key,
       cast(doc_id % 5 + 1 as integer) as rating, concat_ws(' ', text, {_remark}) as review_text,
       cast(length(concat_ws(' ', text, {_remark})) as integer) as text_length,
       cast(date '2024-01-01' + cast(doc_id % 180 as integer) as date) as review_date
from documents""")

relation("text_topics", """
select cast(doc_id as varchar) as review_id,
       unnest([lang, source, case when n_chars >= 1000 then 'long_text' else 'short_text' end]) as topic
from documents""")
