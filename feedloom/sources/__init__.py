"""Readers, writers and schemas of the review warehouse."""
