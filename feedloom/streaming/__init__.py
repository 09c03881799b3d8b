"""Structured Streaming forms of the daily and hourly jobs."""
