"""Label batches, agreement between two label sources, classifier scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import literal_array, ratio, stable_round

MIN_SUPPORT = 5
# The notes of unscored and weakly supported topics.
LOW_SUPPORT = "LOW SUPPORT -- interpret cautiously"
NOT_SCOREABLE = "no positive examples in either -- not scoreable"


def merge_labels(sample: DataFrame, batch: DataFrame, labeler: str, index: str = "i") -> DataFrame:
    """Attach label records to sample rows by their row index."""
    return (sample.join(batch, index)
            .withColumn("topics", F.array_join("topics", ";"))
            .withColumn("labeler", F.lit(labeler)))


def batch_integrity(batch: DataFrame, expected: int, index: str = "i") -> DataFrame:
    """Record count, uniqueness and gaps of a batch's row index, as check rows."""
    stats = batch.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d"),
                      F.min(index).alias("lo"), F.max(index).alias("hi"))
    gap = F.when((F.col("lo") == 0) & (F.col("hi") == F.col("d") - 1), 0).otherwise(1)
    checks = F.array(
        F.struct(F.lit("expected_count").alias("check"), F.abs(F.col("n") - expected).cast("bigint").alias("n_violations")),
        F.struct(F.lit("unique_index").alias("check"), (F.col("n") - F.col("d")).cast("bigint").alias("n_violations")),
        F.struct(F.lit("contiguous_index").alias("check"), gap.cast("bigint").alias("n_violations")))
    return stats.select(F.explode(checks).alias("c")).select("c.*").withColumn("passed", F.col("n_violations") == 0)


def label_frequency(labelled: DataFrame, topics: str = "topics") -> DataFrame:
    """Rows per label of an array column and the share of all rows."""
    total = labelled.agg(F.count(F.lit(1))).scalar()
    return (labelled.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", 100.0 * F.col("n") / total))


def flag_rate(df: DataFrame, flag: str) -> DataFrame:
    """Rows, positives and positive share of a boolean column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(flag).alias("n_positive"),
                  F.avg(F.col(flag).cast("double")).alias("positive_share"))


def multi_hot(topics: Column, vocabulary: list[str]) -> Column:
    """0/1 array in vocabulary order for a label array (null counts as empty)."""
    have = F.coalesce(topics, F.array().cast("array<string>"))
    return F.transform(literal_array(vocabulary), lambda t: F.array_contains(have, t).cast("int"))


def merge_checked(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join of two one-row-per-key frames, and a check that nothing was lost or doubled."""
    merged = left.join(right, key)
    check = left.agg(F.count(F.lit(1)).alias("n_left")).withColumn(
        "n_merged", merged.agg(F.count(F.lit(1))).scalar()).withColumn(
        "n_violations", F.abs(F.col("n_left") - F.col("n_merged"))).withColumn(
        "passed", F.col("n_violations") == 0)
    return merged, check


def label_grid(pairs: DataFrame, vocabulary: list[str], truth: str, predicted: str) -> DataFrame:
    """Rows (topic, truth 0/1, predicted 0/1) of two label arrays over a vocabulary."""
    none = F.array().cast("array<string>")
    cell = F.transform(literal_array(vocabulary), lambda t: F.struct(
        t.alias("topic"),
        F.array_contains(F.coalesce(F.col(truth), none), t).cast("int").alias("truth"),
        F.array_contains(F.coalesce(F.col(predicted), none), t).cast("int").alias("predicted")))
    return pairs.select(F.explode(cell).alias("c")).select("c.*")


def confusion(grid: DataFrame, *keys: str) -> DataFrame:
    """True/false positives and negatives per topic, in one aggregation."""
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    return grid.groupBy("topic", *keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 (zero where undefined), kappa and both supports."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    observed = (tp + tn) / n
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return (counts
            .withColumn("precision", _or_zero(ratio(tp, tp + fp)))
            .withColumn("recall", _or_zero(ratio(tp, tp + fn)))
            .withColumn("f1", _or_zero(ratio(2.0 * tp, 2.0 * tp + fp + fn)))
            .withColumn("kappa", ratio(observed - expected, 1.0 - expected))
            .withColumn("support_truth", F.col("tp") + F.col("fn"))
            .withColumn("support_predicted", F.col("tp") + F.col("fp")))


def agreement(counts: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per-topic agreement of a person (truth) with another labeller."""
    scored = precision_recall(counts)
    empty = (F.col("support_truth") == 0) & (F.col("support_predicted") == 0)
    note = (F.when(empty, NOT_SCOREABLE).when(F.col("support_truth") >= min_support, "").otherwise(LOW_SUPPORT))
    shown = [F.when(~empty, stable_round(F.col(c), 3)).alias(c) for c in ("kappa", "precision", "recall", "f1")]
    return scored.select("topic", *shown, F.col("support_truth").alias("support_human"),
                         F.col("support_predicted").alias("support_ai"), note.alias("note"))


def flag_agreement(pairs: DataFrame, human: str, other: str) -> DataFrame:
    """Kappa and positives of a yes/no flag set by a person and by another labeller; a null counts as no."""
    cell = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(n) for c, n in ((human, "truth"), (other, "predicted"))]
    scored = precision_recall(confusion(pairs.select(F.lit(human).alias("topic"), *cell)))
    return scored.select((F.col("tp") + F.col("fn")).alias("human_positives"), (F.col("tp") + F.col("fp")).alias("other_positives"),
                         (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"), stable_round(F.col("kappa"), 3).alias("kappa"))


def macro_agreement(per_topic: DataFrame) -> DataFrame:
    """Mean kappa and F1 over the scoreable topics."""
    ok = F.col("kappa").isNotNull()
    return per_topic.filter(ok).agg(F.count(F.lit(1)).alias("n_scoreable"), F.avg("kappa").alias("macro_kappa"),
                                    F.avg("f1").alias("macro_f1"))


def evaluation(counts: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Held-out scores per topic with low support flagged."""
    note = F.when(F.col("support_truth") >= min_support, "").otherwise(LOW_SUPPORT)
    return precision_recall(counts).select(
        "topic", F.col("support_truth").alias("support_test"),
        *[stable_round(F.col(c), 3).alias(c) for c in ("precision", "recall", "f1")], note.alias("note"))


def overall_f1(counts: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Macro F1 over all and over supported topics (of the rounded scores), and micro F1."""
    f1 = stable_round(F.col("f1"), 3)
    supported = F.col("support_truth") >= min_support
    micro = _or_zero(ratio(2.0 * F.sum("tp"), 2.0 * F.sum("tp") + F.sum("fp") + F.sum("fn")))
    return precision_recall(counts).agg(
        F.avg(f1).alias("macro_f1_all"), F.avg(F.when(supported, f1)).alias("macro_f1_supported"),
        F.count_if(supported).alias("n_supported"), micro.alias("micro_f1"))


def best_thresholds(scores: DataFrame, grid: list[float]) -> DataFrame:
    """Per topic the probability threshold of the grid with the highest F1.

    `scores` holds (topic, truth, probability). Rows are counted by the number of thresholds
    they pass, and only those few counts meet every threshold; ties go to the lowest one.
    """
    steps = sorted(float(g) for g in grid)
    passed = F.size(F.filter(literal_array(steps), lambda g: F.col("probability") >= g))
    cells = scores.groupBy("topic", passed.alias("_passed")).agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n"))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("threshold")) for i, g in enumerate(steps)])
    above = F.col("_passed") > F.col("s.i")
    counts = cells.withColumn("s", F.explode(every)).groupBy("topic", F.col("s.threshold").alias("threshold")).agg(
        *[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name) for name, side, c in (("tp", above, "p"), ("fp", above, "n"), ("fn", ~above, "p"), ("tn", ~above, "n"))])
    scored = precision_recall(counts)
    order = Window.partitionBy("topic").orderBy(F.col("f1").desc(), "threshold")
    return (scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1)
            .select("topic", "threshold", "f1"))
