"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document stands in the queue of its source in a shuffled order, once per allowed
pass. Its virtual finish time is the source's cumulative size divided by the source's
target; documents are served by finish time until the total budget is spent.

Sources in code-point order (null last) take the weights in turn; a target above
`passes` times its source's size stops there and the excess is shared again by weight,
which is water-filling over the ratio of cap and weight.

Cumulative sums are taken in two levels, so that no source and no stretch of the queue
has to fit one task: rows fall into slices of the order, the slices' totals (bounded by
the slice count and the number of sources) are accumulated, and rows are accumulated
only inside their slice. One row per source passes a single task.

Null sizes count 0, a null source is a source, empty tables give an empty result, a
document of size 0 is never counted, and rows that repeat in full are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import ROW, WORDS, numbered, written

SLICES = 4096


def _running(df: DataFrame, group: list[str], part: str, order: list, size: str, out: str) -> DataFrame:
    """Sum of `size` up to and with each row in the order of (part, order), inside group."""
    totals = df.groupBy(*group, part).agg(F.sum(size).alias("_part_size"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_part_size").over(before), F.lit(0))).drop("_part_size")
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn(out, F.sum(size).over(inside)).join(totals, [*group, part])
            .withColumn(out, F.col(out) + F.col("_before")).drop("_before"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, passes: int) -> DataFrame:
    """(source, source_size) -> with rank and target, by water-filling."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ratio = Window.orderBy("_ratio", "rank")
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    weighed = (sources.withColumn("rank", F.row_number().over(by_name) - 1)
               .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
               .withColumn("_cap", passes * F.col("source_size").cast("double"))
               .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
               .withColumn("_left", share * F.sum("source_size").over(everything)
                           - F.coalesce(F.sum("_cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
               .withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
               # the first source whose cap is not below the level fixes the level for the rest
               .withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "rank", "_level"))).over(everything)["_level"]))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_weight")))
    return weighed.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, passes: int = 2,
        id_col: str = "doc_id", source_col: str = "source", size: F.Column | None = None, seed: str = "mix",
        slices: int = SLICES, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (size times copies), and row_col if given.

    A document's ticket is a hash of its id, or of all its columns if it has none.
    """
    size = F.regexp_count(F.col("text"), F.lit(WORDS)) if size is None else size
    row = [] if row_col is None else [row_col]
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in row]))
    name = F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string")).otherwise(F.concat_ws(":", F.lit("null"), content))
    ticket = F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary"))
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                F.coalesce(size, F.lit(0)).cast("long").alias("size"), ticket.alias("ticket"), *row), "mix-sizes")
    aims = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes), "mix-targets")
    rows = sized.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part = F.floor(F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32))
    queue = written(_running(rows.withColumn("_part", part), ["rank"], "_part", ["ticket", "doc_id", "size"], "size", "_cum"), "mix-queue")

    def finish(turn) -> F.Column:
        return F.coalesce((F.col("_cum") + turn * F.col("source_size")) / F.col("target"), F.lit(0.0))

    # Finish time 1 is where every queue meets its target, so the budget ends close to it.
    budget = aims.agg(F.sum("source_size")).first()[0] or 0
    budget *= share
    turns = queue.where("size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("_finish", finish(F.col("_turn")))
    stretch = F.floor(F.least(F.col("_finish"), F.lit(2.0)) * slices)
    totals = turns.groupBy(stretch.alias("_stretch")).agg(F.sum("size").alias("_total"))
    totals = totals.withColumn("_served", F.sum("_total").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)))
    over = totals.where(F.col("_served") > budget).agg(F.min(F.struct("_stretch", (F.col("_served") - F.col("_total")).alias("before"))).alias("x")).first()[0]
    if over is None:
        copies = F.when(F.col("size") > 0, F.lit(passes)).otherwise(0)
    else:
        # the stretch in which the budget ends: its rows alone are accumulated one by one
        order = ["_finish", "rank", "_turn", "ticket", "doc_id", "size"]
        inside = turns.where(stretch == over["_stretch"]).withColumn(
            "_served", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + over["before"])
        last = inside.where(F.col("_served") > budget).agg(F.min(F.struct(*order)).alias("x")).first()[0]

        def served(turn: int) -> F.Column:
            own = F.struct(finish(F.lit(turn)).alias("_finish"), "rank", F.lit(turn).alias("_turn"), "ticket", "doc_id", "size")
            limit = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in zip(order, ("double", "int", "int", "string", "long", "long"), strict=True)])
            return ((F.col("size") > 0) & (own < limit)).cast("int")
        copies = sum((served(t) for t in range(1, passes)), served(0))
    return queue.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *row)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, in their own columns; rows that share an id are taken each by itself."""
    rows = numbered(docs, "mix-rows")
    chosen = mix(rows, row_col=ROW, **options).where("copies > 0").select(ROW, F.col("copies").alias("_copies"))
    turns = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_turn")
    return rows.join(chosen, ROW).select(*docs.columns, turns).select(*docs.columns)
