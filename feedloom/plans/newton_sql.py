"""Balanced logistic regression in SQL: a fixed number of Newton steps, each solved by elimination."""

from __future__ import annotations

from feedloom.operators.classifiers import TRAINING_ROWS
from feedloom.plans.reference_sql import relation, uniform

STEPS = 9       # from zero; the last ones no longer change the sixth decimal


def newton(name: str, dims: int, penalty: float = 1.0, steps: int = STEPS) -> None:
    """Relations `{name}_chance` (id, topic, p) over all rows.

    Needs `{name}_rows` (id, x, train), x without intercept, and `{name}_marks` (id, topic, y) of the training rows.
    """
    d = dims + 1
    relation(f"{name}_values", f"select id, train, i, ([cast(1 as double)] || x)[i] as v from {name}_rows cross join (select unnest(range(1, {d + 1})) as i)", True)
    relation(f"{name}_products", f"""
select a.id, a.i, b.i as j, a.v * b.v as v from {name}_values a join {name}_values b on a.id = b.id and a.i <= b.i where a.train""", True)
    relation(f"{name}_weights", f"""
select topic, count(*) / (2.0 * sum(y)) as up, count(*) / (2.0 * (count(*) - sum(y))) as down from {name}_marks group by topic having sum(y) > 0 and sum(y) < count(*)""", True)
    relation(f"{name}_theta_0", f"select topic, i, cast(0 as double) as b from {name}_weights cross join (select unnest(range(1, {d + 1})) as i)", True)
    for t in range(steps):
        relation(f"{name}_errors_{t}", f"""
select z.topic, z.id, w * (p - y) as gc, w * p * (1 - p) as hc from (
  select topic, id, 1 / (1 + exp(-sum(b * v))) as p from {name}_theta_{t} join {name}_values using (i) where train group by 1, 2) z
join (select m.id, m.topic, m.y, case when y = 1 then up else down end as w from {name}_marks m join {name}_weights using (topic)) m on m.id = z.id and m.topic = z.topic""", True)
        relation(f"{name}_gradient_{t}", f"""
select s.topic, s.i, s.g + case when s.i > 1 then {penalty} * b else 0 end as g from (
  select topic, i, sum(gc * v) as g from {name}_errors_{t} join {name}_values using (id) group by 1, 2) s join {name}_theta_{t} t on t.topic = s.topic and t.i = s.i""", True)
        relation(f"{name}_curvature_{t}", f"""
select topic, i, j, sum(hc * v) + case when i = j and i > 1 then {penalty} else 0 end as h from {name}_errors_{t} join {name}_products using (id) group by 1, 2, 3""", True)
        relation(f"{name}_system_{t}", f"""
select topic, list(r order by i) as m from (
  select c.topic, c.i, list_append(list(h order by j), any_value(g)) as r from (
    select topic, i, j, h from {name}_curvature_{t} union all select topic, j, i, h from {name}_curvature_{t} where i < j) c
  join {name}_gradient_{t} g on g.topic = c.topic and g.i = c.i group by 1, 2) group by 1""", True)
        relation(f"{name}_{t}_recursive_steps", f"""
select topic, 1 as k, m from {name}_system_{t} union all
select topic, k + 1, list_transform(m, lambda r, q: case when q = k then pr else list_transform(r, lambda e, c: e - r[k] * pr[c]) end)
from (select topic, k, m, list_transform(m[k], lambda e: e / m[k][k]) as pr from {name}_{t}_recursive_steps where k <= {d})""")
        relation(f"{name}_theta_{t + 1}", f"""
select topic, i, b - m[i][{d + 1}] as b from {name}_theta_{t} join (select topic, m from {name}_{t}_recursive_steps where k = {d + 1}) using (topic)""", True)
    relation(f"{name}_chance", f"""
select id, topic, 1 / (1 + exp(-sum(b * v))) as p from {name}_theta_{steps} join {name}_values using (i) group by 1, 2
union all select r.id, m.topic, avg(y) from {name}_rows r cross join {name}_marks m group by 1, 2 having min(y) = max(y)""", True)


def kept(rows: str, key: str) -> str:
    """Condition of the bounded sample of training rows."""
    return f"{uniform(11, key)} * (select count(*) from {rows}) <= {TRAINING_ROWS}"
