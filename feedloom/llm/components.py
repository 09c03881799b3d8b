"""Connected components of a link table, by alternating star contractions.

Every round points the larger neighbours of a node at its smallest neighbour (large
star), then the smaller ones (small star), until only stars are left, one per component
around its smallest id. A round is an aggregation and an equality join, both of which
Spark can split at a hot id; its result is a table in the shared folder. Links are first
thinned to a spanning star forest inside each task.

An empty table gives an empty result; repeated links, links of an id to itself and
either direction are accepted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, mapped, rows_out, travels, written

travels(__name__)

HELD_LINKS = 1 << 20


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for the ids of some links, without the centres."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)   # whole stars move together
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(ids))
    return ids[far], ids[low[far]]


def _thinned(links: DataFrame) -> DataFrame:
    schema = arrow("a long, b long")

    def task(batches):
        held, size = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size > HELD_LINKS:
                held = [star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_LINKS // 2:
                    yield rows_out(schema, held[0])
                    held, size = [], 0
        if held:
            yield rows_out(schema, star_forest(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return mapped(links, task, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> (id, component): every id of a link and the smallest id it reaches."""
    edges = written(_thinned(links.where("a <> b").select("a", "b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")
    centres = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(centres)
