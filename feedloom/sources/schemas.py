"""Declared schemas of every input and result table."""

RAW_REVIEWS = """reviewId string, content string, score int, thumbsUpCount int,
    reviewCreatedVersion string, at timestamp_ntz, replyContent string, repliedAt timestamp_ntz,
    appVersion string, user_hash string, app_key string, scraped_at timestamp_ntz"""

REVIEW_TOPICS = "review_id string, topic string, probability double"
REVIEW_FLAGS = "review_id string, churn_intent boolean, churn_probability double"

TOPIC_LABEL_BATCH = "i bigint, topics array<string>, churn_intent boolean, competitor_mentioned string"
CHURN_LABEL_BATCH = "i bigint, churn_intent boolean"

INCIDENTS_CSV = """incident_id string, apps_affected string, start_time_ist string,
    first_public_report_ist string, type string, source_1 string, source_2 string,
    source_3 string, source_4 string, notes string"""

ANSWER_KEY = "review_id string, topics string, churn_intent boolean, competitor_mentioned string"

DIM_APP = """app_key string, display_name string, is_focus_app boolean, store_id string,
    downloads_verified bigint, rating_verified double, reviews_verified_label string"""
DIM_TOPIC = "topic_key string, display_name string, category string, is_actionable_issue boolean"
