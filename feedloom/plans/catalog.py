"""All registered queries; importing this module fills the registry."""

from feedloom.plans import alert_queries, backlog_queries, causal_queries, label_queries, publish_queries, report_queries, review_queries, switching_queries  # noqa: F401
from feedloom.plans.registry import BUILDERS, STATEMENTS  # noqa: F401
