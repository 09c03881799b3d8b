"""Small expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null when the denominator is zero or null."""
    d = denominator.cast("double")
    return F.when(d != 0, numerator.cast("double") / d)


def share_of(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that ignores floating noise beyond the tenth decimal."""
    return F.round(F.round(value, 10), digits)


def seconds_since_epoch(ts: Column) -> Column:
    """Wall-clock seconds of a timestamp, independent of the session time zone."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr(EPOCH))


def floor_to_bin(ts: Column, bin_hours: Column) -> Column:
    """Start of the N-hour bin that holds `ts`; N may differ from row to row."""
    width = bin_hours * F.lit(3600)
    return from_epoch_seconds(F.floor(seconds_since_epoch(ts) / width) * width)


def hours_between(start: Column, end: Column) -> Column:
    return (seconds_since_epoch(end) - seconds_since_epoch(start)) / F.lit(3600.0)


def literal_map(values: dict) -> Column:
    """A configured dictionary as a map literal (bounded by the configuration)."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
