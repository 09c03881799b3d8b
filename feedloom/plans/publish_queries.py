"""All models over the given tables: written once, tested, published, exported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.operators import alerts, backlog, causal, marts, staging, switching
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs, switching_queries
from feedloom.plans.reference_sql import relation, values
from feedloom.plans.registry import register
from feedloom.session import cut_lineage, scratch_path
from feedloom.sources import files
from feedloom.sources.publish import Model, Run, Tests, publish

_ALL_TOPICS = fx.TYPE_TOPICS + fx.NOUN_TOPICS
_MANUAL = ("gear",)


def models(s, d, topics: list[str]) -> list[Model]:
    """The staging, intermediate and mart tables in the order in which they follow from each other."""

    def impact(t):
        windows = causal.release_windows(t["fct_daily_app_metrics"], t["int_version_adoption"], fx.FOCUS)
        placebos = causal.placebo_dates(windows)
        effects = cut_lineage(causal.did_effects(t["fct_daily_app_metrics"], causal.candidate_dates(windows, placebos), fx.FOCUS, fx.CONTROLS))
        return staging.stage_release_impact(causal.release_impact(windows, effects, causal.placebo_effects(effects, placebos)))

    def issues(t):
        # The written labels: they have all rows of every staged review, and its date.
        reviews, topics, flags = t["stg_reviews"].select("review_id", "app_key", "review_date", "text_length", "rating"), t["stg_review_topics"], t["stg_review_flags"]
        penalties = backlog.rating_penalties(backlog.review_cells(reviews, topics, fx.ISSUE_TOPICS), fx.ISSUE_TOPICS)
        scored = cut_lineage(backlog.rice(backlog.issue_cost(reviews, topics, flags, penalties), fx.DOWNLOADS, fx.TOPIC_F1, fx.EFFORT_WEEKS))
        return staging.stage_backlog(backlog.rice_stability(scored), _MANUAL)

    def samples(t):
        chosen = cut_lineage(marts.review_samples(marts.worst_rated(t["stg_review_topics"])))
        return chosen.join(t["stg_reviews"].select("review_id", "review_text"), "review_id")

    def scored_episodes(t):
        return staging.stage_alerts(alerts.episodes(cut_lineage(alerts.scored_bins(fx.event_reviews(s, d), fx.BIN_HOURS))))

    app = {"app_key": ("dim_app", "app_key")}
    return [
        Model("dim_app", lambda t: marts.dim_app(s, fx.DIM_APP_ROWS), Tests(("app_key",), ("app_key",)), True),
        Model("dim_topic", lambda t: marts.dim_topic(s, fx.DIM_TOPIC_ROWS), Tests(("topic_key",), ("topic_key",)), True),
        Model("stg_reviews", lambda t: inputs.reviews(s, d),
              Tests(("review_id", "rating", "app_key", "review_text", "reviewed_at"), ("review_id",), {"rating": [1, 2, 3, 4, 5], "app_key": fx.APPS})),
        Model("stg_review_topics", lambda t: staging.stage_topics(fx.raw_topics(s, d), t["stg_reviews"], ("rating",)),
              Tests(("review_id", "topic", "app_key"), accepted={"topic": topics})),
        Model("stg_review_flags", lambda t: staging.stage_flags(fx.raw_flags(s, d), t["stg_reviews"]), Tests(("review_id", "churn_intent", "app_key"), ("review_id",))),
        Model("day_cells", lambda t: marts.day_cells(t["stg_reviews"])),
        Model("int_version_adoption", lambda t: marts.adoption_from_cells(t["day_cells"]), Tests(("app_key", "review_version", "adoption_date", "total_reviews"))),
        Model("fct_daily_app_metrics", lambda t: marts.daily_from_cells(t["day_cells"]),
              Tests(("app_key", "review_date", "n_reviews", "negative_share", "avg_rating", "is_complete_day"),
                    ranges={"avg_rating": (1, 5), "negative_share": (0, 1)}, references=app), True),
        Model("dim_date", lambda t: marts.dim_date(t["fct_daily_app_metrics"]), Tests(("date",), ("date",)), True),
        Model("fct_daily_topic_metrics", lambda t: marts.daily_topic_metrics(t["stg_review_topics"], t["fct_daily_app_metrics"]),
              Tests(("app_key", "review_date", "topic", "n_topic_reviews"), references={"topic": ("dim_topic", "topic_key")}), True),
        Model("stg_release_impact", impact, Tests(("version", "app_key"))),
        Model("fct_release_impact", lambda t: t["stg_release_impact"], Tests(("version",), ("version",)), True),
        Model("dim_version", lambda t: marts.dim_version(t["int_version_adoption"], t["fct_release_impact"]), Tests(("app_key", "review_version")), True),
        Model("stg_alerts", scored_episodes, Tests(("app_key", "alert_start"))),
        Model("fct_alerts", lambda t: t["stg_alerts"], Tests(("app_key",)), True),
        Model("stg_incidents", lambda t: fx.incidents(s)),
        Model("stg_switching_matrix", lambda t: staging.stage_switching(switching.bootstrap_ci(switching_queries._flows(s, d))), Tests(("source", "dest", "n"))),
        Model("fct_switching", lambda t: t["stg_switching_matrix"], published=True),
        Model("stg_issue_backlog", issues, Tests(("app_key", "topic", "rice"))),
        Model("fct_issue_backlog", lambda t: t["stg_issue_backlog"], published=True),
        Model("fct_review_samples", samples, Tests(("review_id",)), True)]


# ---------------------------------------------------------------- the same tests in SQL

relation("dates", "select cast(d as date) as date from generate_series((select min(review_date) from stg_reviews), (select max(review_date) from stg_reviews), interval 1 day) as t(d)")

_DIM_APP = f"(select * from {values([r[:3] for r in fx.DIM_APP_ROWS])} as t(app_key, display_name, is_focus_app))"
_DIM_TOPIC = f"(select * from {values(fx.DIM_TOPIC_ROWS)} as t(topic_key, display_name, category, actionable))"
_IMPACT = f"(select *, '{fx.FOCUS}' as app_key from impact_q)"
_SAMPLES = """(select * from (select review_id, row_number() over (partition by app_key, topic, strftime(review_date, '%Y-%m')) as rk from stg_topics) where rk <= 8)"""
_ALERTS = "(select app_key, start_time as alert_start from found_episodes)"
_BACKLOG = "(select r.* from rice_rows r join stability s on s.app_key = r.app_key and s.topic = r.topic)"
_RELATIONS = {
    "dim_app": _DIM_APP, "dim_topic": _DIM_TOPIC, "dim_date": "dates", "dim_version": "adoption", "stg_reviews": "stg_reviews", "stg_review_topics": "stg_topics",
    "stg_review_flags": "stg_flags", "int_version_adoption": "adoption", "fct_daily_app_metrics": "daily", "fct_daily_topic_metrics": "topic_daily",
    "stg_release_impact": _IMPACT, "fct_release_impact": _IMPACT, "stg_alerts": _ALERTS, "fct_alerts": _ALERTS, "stg_switching_matrix": "flow_rows",
    "fct_switching": "flow_rows", "stg_issue_backlog": _BACKLOG, "fct_issue_backlog": _BACKLOG, "fct_review_samples": _SAMPLES}


def _sql(table: str, check: str, column: str, violations: str) -> str:
    return f"select '{table}' as table_name, '{check}' as check_name, '{column}' as column_name, cast(({violations}) as bigint) as n_violations"


def _tests_sql(table: str, tests: Tests) -> list[str]:
    rel = _RELATIONS.get(table)
    return ([_sql(table, "not_null", c, f"select count(*) from {rel} where {c} is null") for c in tests.not_null]
            + [_sql(table, "unique", c, f"select count(*) from (select {c} from {rel} where {c} is not null group by 1 having count(*) > 1)") for c in tests.unique]
            + [_sql(table, "accepted_values", c, f"select count(*) from {rel} where {c} not in ({', '.join(map(repr, v))})") for c, v in tests.accepted.items()]
            + [_sql(table, "in_range", c, f"select count(*) from {rel} where {c} < {lo} or {c} > {hi}") for c, (lo, hi) in tests.ranges.items()]
            + [_sql(table, "relationships", c, f"select count(*) from {rel} where {c} not in (select {k} from {_RELATIONS[t]})") for c, (t, k) in tests.references.items()])


_MODELS = models(None, None, fx.ISSUE_TOPICS)

# Topics outside the issue vocabulary are reported here, so that a test that fails is among the rows.
register("dq_report", lambda s, d: Run(s).write_all(models(s, d, fx.ISSUE_TOPICS)).report_frame(),
         "select *, n_violations = 0 as passed from (" + "\nunion all ".join(q for m in _MODELS for q in _tests_sql(m.name, m.tests)) + ")")


def _published(s, d):
    """Publish all models, export every published table from the catalog, count the exported rows."""
    database = f"marts_{uuid.uuid4().hex}"
    chosen = models(s, d, _ALL_TOPICS)
    publish(s, chosen, database, scratch_path(s, "marts"))
    names = [m.name for m in chosen if m.published]
    counts = files.export_csv({n: s.table(f"{database}.{n}") for n in names}, scratch_path(s, "exports"), {"fct_issue_backlog": ["app_key", F.desc("rice")]})
    s.sql(f"DROP DATABASE {database} CASCADE")      # the tables are external: their files stay
    return s.createDataFrame(list(counts.items()), "table_name string, n_rows long")


register("published_tables", _published, "\nunion all ".join(
    f"select '{m.name}' as table_name, (select count(*) from {_RELATIONS[m.name]}) as n_rows" for m in _MODELS if m.published))
