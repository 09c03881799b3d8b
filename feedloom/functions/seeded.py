"""Reproducible randomness: every draw is a hash of a seed and the row's key.

A hash draw does not depend on partitioning, task order or retries, so samples
survive executor loss unchanged and can be recomputed in any engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = float(16 ** 13)


def seeded_digest(seed: int | str, *keys: Column) -> Column:
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def seeded_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of the digest."""
    bits = F.conv(F.substring(seeded_digest(seed, *keys), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(_STEPS)


def weighted_key(seed: int | str, weight: Column, *keys: Column) -> Column:
    """Sort key for weighted sampling without replacement (smallest keys win)."""
    u = F.greatest(seeded_uniform(seed, *keys), F.lit(1e-15))
    return -F.log(u) / weight
