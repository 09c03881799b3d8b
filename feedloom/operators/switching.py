"""Brand switching: who is mentioned, how, and the flows between products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import bind, ratio
from feedloom.functions.seeded import seeded_uniform
from feedloom.functions.stats import binomial_draw
from feedloom.functions.text import FLAGS, any_of, folded, mentions_any

AWAY, ARRIVED, COMPARED, NONE = "switching_away", "switched_from_competitor", "comparison_only", "none"

# The phrase patterns that define each relation; {app} stands for
# the variants of the other product's name.
RELATION_PATTERNS = {
    AWAY: [
        r"switch(?:ing|ed)?\s+to\s+(?:the\s+)?{app}",
        r"mov(?:e|ing|ed)\s+to\s+(?:the\s+)?{app}",
        r"shift(?:ing|ed)?\s+to\s+(?:the\s+)?{app}",
        r"migrat(?:e|ing|ed)\s+to\s+(?:the\s+)?{app}",
        r"go(?:ing)?\s+(?:back\s+)?to\s+(?:use\s+)?(?:the\s+)?{app}",
        r"going\s+for\s+{app}",
        r"(?:will|gonna|i\s*'?ll)\s+use\s+{app}",
        r"better\s+(?:to\s+)?use\s+{app}",
        r"use\s+{app}\s+instead",
        r"instead\s+use\s+{app}",
        r"uninstall(?:ing|ed)?.{0,40}(?:use|try)\s+{app}",
        r"deleting.{0,20}using\s+{app}",
        r"(?:now|so|then)?\s*(?:i\s*'?m\s+|i\s+am\s+)using\s+{app}",
        r"stick(?:ing)?\s+with\s+{app}",
        r"mostly\s+use\s+{app}",
    ],
    ARRIVED: [
        r"came\s+from\s+{app}",
        r"switched\s+from\s+{app}",
        r"mov(?:ed|ing)\s+from\s+{app}",
        r"shifted\s+from\s+{app}",
        r"used\s+to\s+use\s+{app}",
        r"previously\s+use[ds]?\s+{app}",
        r"earlier\s+(?:i\s+)?use[ds]?\s+{app}",
        r"left\s+{app}",
    ],
    COMPARED: [
        r"{app}(?:\s+\w+){0,2}\s+is\s+(?:\w+\s+){0,2}(?:better|worse|easier|faster|slower|best|hero)",
        r"(?:better|worse|easier|faster|slower|more\s+useful|more\s+better)\s+than\s+{app}",
        r"unlike\s+{app}",
        r"compared\s+to\s+{app}",
        r"compare\s+(?:with|to)\s+{app}",
        r"{app}\s+(?:gives?|has|offers?|provides?)",
        r"like\s+{app}",
        r"same\s+as\s+{app}",
        r"not\s+like\s+{app}",
        r"rather\s+than\s+{app}",
        r"(?:isse|is\s+se)\s+(?:acha|accha|behtar|best)\s+{app}",
        r"{app}\s+(?:hero|best|acha|accha|behtar)\s+hai",
        r"{app}\s+se\s+(?:acha|accha|behtar)",
    ],
}


def relation_regex(relation: str, variants) -> str:
    """All phrases of a relation for one product as a single alternation."""
    app = f"(?:{any_of(variants)})"
    return "|".join(p.replace("{app}", app) for p in RELATION_PATTERNS[relation])


def mentioned(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Products named in the text, in dictionary order."""
    def named(t: Column) -> Column:
        return F.array(*[F.when(mentions_any(t, variants), F.lit(app)) for app, variants in aliases.items()])

    return F.filter(bind(folded(text), named), lambda x: x.isNotNull())


def with_mentions(reviews: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """All reviews with the other products they name, and the texts of those that name one.

    Written once, it serves the relations and the totals of each app from one pass over the texts.
    """
    others = F.array_remove(mentioned(F.col("review_text"), aliases), F.col("app_key"))
    return reviews.withColumn("other_mentions", others).select(
        "review_id", "app_key", "rating", "review_date", "other_mentions", F.when(F.size("other_mentions") > 0, F.col("review_text")).alias("review_text"))


def mention_candidates(reviews: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Reviews that name a product other than their own; `reviews` may come from `with_mentions`."""
    named = reviews if "other_mentions" in reviews.columns else with_mentions(reviews, aliases)
    return (named.filter(F.size("other_mentions") > 0)
            .select("review_id", "app_key", "rating", "review_text", "review_date", "other_mentions",
                    F.array_join("other_mentions", ";").alias("other_mentions_str"),
                    F.size("other_mentions").alias("n_other_mentions")))


def relation_of(text: Column, other_app: Column, aliases: dict[str, list[str]]) -> Column:
    """First relation whose phrases occur, in the order away, arrived, compared."""
    def by_app(t: Column) -> Column:
        case = F.when(F.lit(False), F.lit(NONE))
        for app, variants in aliases.items():
            kind = F.lit(NONE)
            for relation in reversed(list(RELATION_PATTERNS)):
                kind = F.when(t.rlike(f"{FLAGS}(?:{relation_regex(relation, variants)})"), F.lit(relation)).otherwise(kind)
            case = case.when(other_app == app, kind)
        return case.otherwise(F.lit(NONE))

    return bind(folded(text), by_app)


def relations(candidates: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One row per review and other product, with the stated relation."""
    return (candidates.withColumn("other_app", F.explode("other_mentions"))
            .withColumn("relation", relation_of(F.col("review_text"), F.col("other_app"), aliases))
            .select("review_id", "app_key", "rating", "review_date", "other_app", "relation"))


def mention_counts(candidates: DataFrame) -> DataFrame:
    return (candidates.select(F.explode("other_mentions").alias("other_app"))
            .groupBy("other_app").agg(F.count(F.lit(1)).alias("n")))


def candidate_share(reviews: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Candidates per app as count and percentage, in one pass over the texts."""
    other = F.size(F.array_remove(mentioned(F.col("review_text"), aliases), F.col("app_key"))) > 0
    return reviews.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(other).alias("n_candidates")).withColumn(
        "pct", 100.0 * F.col("n_candidates") / F.col("n_reviews"))


def relation_crosstab(rel: DataFrame) -> DataFrame:
    return (rel.groupBy("other_app").pivot("relation", [AWAY, ARRIVED, COMPARED, NONE])
            .agg(F.count(F.lit(1))).fillna(0))


def flows(rel: DataFrame) -> DataFrame:
    """Directed moves: away leaves the reviewed app, arrived comes to it."""
    left = F.col("relation") == AWAY
    return (rel.filter(F.col("relation").isin(AWAY, ARRIVED))
            .withColumn("source", F.when(left, F.col("app_key")).otherwise(F.col("other_app")))
            .withColumn("dest", F.when(left, F.col("other_app")).otherwise(F.col("app_key"))))


def flow_counts(moves: DataFrame, totals: DataFrame) -> DataFrame:
    """Moves per pair, per 10,000 reviews of the source where those are known."""
    known = totals.select(F.col("app_key").alias("source"), F.col("n").alias("source_total_reviews"))
    return (moves.groupBy("source", "dest").agg(F.count(F.lit(1)).alias("n"))
            .join(known, "source", "left")
            .withColumn("per_10k", ratio(F.col("n"), F.col("source_total_reviews")) * 10000.0))


def bootstrap_ci(counts: DataFrame, runs: int = 1000, seed: int = 2026,
                 bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """95% bootstrap interval of each known rate.

    Resampling n reviews of which k are positive and counting the positives is
    a Binomial(n, k/n) draw, so a run costs one draw instead of n.
    """
    known = counts.filter(F.col("source_total_reviews").isNotNull())
    draws = known.withColumn("_run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    u = seeded_uniform(seed, F.col("source"), F.col("dest"), F.col("_run"))
    rate = ratio(binomial_draw(u, F.col("source_total_reviews"), F.col("n")), F.col("source_total_reviews")) * 10000.0
    interval = (draws.withColumn("_rate", rate).groupBy("source", "dest").agg(
        F.percentile("_rate", F.lit(bounds[0])).alias("per_10k_ci_low"),
        F.percentile("_rate", F.lit(bounds[1])).alias("per_10k_ci_high")))
    return counts.join(interval, ["source", "dest"], "left")


def switching_matrix(rel: DataFrame, reviews: DataFrame, runs: int = 1000, seed: int = 2026) -> DataFrame:
    """Flow counts, rates and intervals."""
    totals = reviews.groupBy("app_key").agg(F.count(F.lit(1)).alias("n"))
    return bootstrap_ci(flow_counts(flows(rel), totals), runs, seed)


def _pairs(counts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The configured pairs as rows, carried by the (small) flow table's session."""
    return counts.sparkSession.createDataFrame(pairs, "a string, b string")


def net_flow(counts: DataFrame, tracked: list[str]) -> DataFrame:
    """Difference of the two directed rates for every pair of tracked apps."""
    pairs = _pairs(counts, [(a, b) for i, a in enumerate(tracked) for b in tracked[i + 1:]])
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("dest"), F.lit(True).alias("forward")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("dest"), F.lit(False).alias("forward")))
    directed = pairs.withColumn("_w", F.explode(ways)).select("a", "b", "_w.*")
    both = directed.join(counts.select("source", "dest", "per_10k"), ["source", "dest"], "left")
    rates = both.groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(F.col("forward"), F.col("per_10k"))), F.lit(0.0)).alias("a_to_b"),
        F.coalesce(F.sum(F.when(~F.col("forward"), F.col("per_10k"))), F.lit(0.0)).alias("b_to_a"))
    toward_b = F.col("a_to_b") - F.col("b_to_a") > 0
    return (rates.withColumn("net_per_10k", F.abs(F.col("a_to_b") - F.col("b_to_a")))
            .withColumn("direction", F.when(toward_b, F.concat_ws("->", "a", "b")).otherwise(F.concat_ws("->", "b", "a"))))


def flow_matrix(counts: DataFrame, tracked: list[str]) -> DataFrame:
    """Tracked apps as rows and columns; the diagonal is null, a missing flow zero."""
    cells = _pairs(counts, [(a, b) for a in tracked for b in tracked])
    named = cells.select(F.col("a").alias("source"), F.col("b").alias("dest"))
    filled = named.join(counts.select("source", "dest", "per_10k"), ["source", "dest"], "left").withColumn(
        "rate", F.when(F.col("source") != F.col("dest"), F.coalesce("per_10k", F.lit(0.0))))
    return filled.groupBy("source").pivot("dest", tracked).agg(F.first("rate"))


def flow_reasons(rel: DataFrame, topics: DataFrame, generic: list[str], top: int = 6) -> DataFrame:
    """Most frequent topics of the reviews behind each outgoing flow."""
    leaving = rel.filter(F.col("relation") == AWAY).select("review_id", "app_key", "other_app")
    counted = (topics.filter(~F.col("topic").isin(*generic)).join(leaving, "review_id")
               .groupBy(F.col("app_key").alias("source"), F.col("other_app").alias("dest"), "topic")
               .agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("source", "dest").orderBy(F.col("n").desc(), "topic")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def monthly_flows(rel: DataFrame, topics: DataFrame, totals: DataFrame, generic: list[str]) -> DataFrame:
    """Flows per month with the rate per 10,000 source reviews and the top reason."""
    month = F.date_format("review_date", "yyyy-MM")
    moves = flows(rel).withColumn("month", month)
    known = totals.select(F.col("app_key").alias("source"), F.col("n").alias("source_total_reviews"))
    counts = moves.groupBy("month", "source", "dest").agg(F.count(F.lit(1)).alias("n"))
    reasons = (topics.filter(~F.col("topic").isin(*generic)).join(moves.select("review_id", "month", "source", "dest"), "review_id")
               .groupBy("month", "source", "dest", "topic").agg(F.count(F.lit(1)).alias("k")))
    order = Window.partitionBy("month", "source", "dest").orderBy(F.col("k").desc(), "topic")
    best = (reasons.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
            .select("month", "source", "dest", F.col("topic").alias("top_reason")))
    return (counts.join(known, "source", "left").join(best, ["month", "source", "dest"], "left")
            .select("month", "source", "dest", "n",
                    (ratio(F.col("n"), F.col("source_total_reviews")) * 10000.0).alias("per_10k"), "top_reason"))


def net_inflow(counts: DataFrame, apps: DataFrame) -> DataFrame:
    """Outflow, inflow and their difference per app; the app dimension plays both roles."""
    out = apps.join(counts, F.col("app_key") == F.col("source")).groupBy("app_key").agg(F.sum("n").alias("outflow"))
    into = apps.join(counts, F.col("app_key") == F.col("dest")).groupBy("app_key").agg(F.sum("n").alias("inflow"))
    return (out.join(into, "app_key", "full").fillna(0, ["outflow", "inflow"])
            .withColumn("net_inflow", F.col("inflow") - F.col("outflow")))
