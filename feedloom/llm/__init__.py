"""Operators for training-data pipelines: mixing, filtering, deduplication, extraction and tokenisation."""
