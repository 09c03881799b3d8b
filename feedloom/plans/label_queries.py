"""Sampling, label, agreement and classifier queries."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from feedloom.operators import classifiers, labels, sampling
from feedloom.plans import fixtures as fx
from feedloom.plans import inputs, newton_sql
from feedloom.plans.inputs import rounded
from feedloom.plans.reference_sql import dec, digest, ratio, relation, sql_list, uniform
from feedloom.plans.registry import register
from feedloom.session import cut_lineage, scratch_path
from feedloom.sources.files import read_label_batches

# ---------------------------------------------------------------- samples


def _sample_relations(prefix: str, source: str) -> None:
    relation(f"{prefix}_sample", f"""
select review_id, app_key, rating, rating_band, review_text, text_length, app_key || '_' || rating_band as stratum from (
  select *, row_number() over (partition by app_key, rating_band order by -ln(greatest({uniform(42, "review_id")}, 1e-15)) / sqrt(greatest(text_length, 1)), review_id) as rk
  from (select *, case when rating between 1 and 2 then 'negative' when rating = 3 then 'neutral' when rating between 4 and 5 then 'positive' end as rating_band from {source}))
where rk <= 67 order by {digest(42, "'trim'", "review_id")}, review_id limit 600""")
    relation(f"{prefix}_split", f"""
select *, case when row_number() over (partition by stratum order by {digest(42, "'split'", "review_id")}, review_id)
                    <= greatest(1, round_even(count(*) over (partition by stratum) * cast(0.25 as double), 0)) then 'dev' else 'test' end as split
from {prefix}_sample""")
    relation(f"{prefix}_indexed", f"""
select *, row_number() over (order by {digest(42, "review_id")}, review_id) - 1 as i from {prefix}_split""")


_sample_relations("review", "stg_reviews")
_sample_relations("text", "text_reviews")


def _split(reviews):
    return sampling.split_dev_test(sampling.stratified_sample(reviews))


_SPLIT_COLUMNS = ("review_id", "app_key", "rating", "rating_band", "text_length", "stratum", "split", "i")

register("stratified_sample", lambda s, d: sampling.shuffled_index(
    _split(inputs.reviews(s, d)), "review_id", 42).select(*_SPLIT_COLUMNS),
    f"select {', '.join(_SPLIT_COLUMNS)} from review_indexed")


def _stratum_summary(s, d):
    reviews = fx.text_reviews(s, d)
    return sampling.stratum_summary(reviews, sampling.stratified_sample(reviews))


register("stratum_summary", _stratum_summary, """
select p.stratum, p.pool_size, p.pool_median_len, t.sampled, t.sample_median_len
from (select app_key || '_' || case when rating <= 2 then 'negative' when rating = 3 then 'neutral' else 'positive' end as stratum,
             count(*) as pool_size, median(text_length) as pool_median_len from text_reviews group by 1) p
join (select stratum, count(*) as sampled, median(text_length) as sample_median_len from text_sample group by 1) t on t.stratum = p.stratum""")

_HITS = "[" + ", ".join(f"case when regexp_matches(lower(review_text), '{p}') then '{t}' end" for t, p in fx.TEXT_TOPIC_PATTERNS.items()) + "]"

relation("boost_rows", f"""
select review_id, app_key, rating, text_length, target_topic from (
  select *, row_number() over (partition by review_id order by list_position([{sql_list(fx.TEXT_TOPIC_PATTERNS)}], target_topic)) as first from (
    select *, row_number() over (partition by target_topic order by {digest(99, "target_topic", "review_id")}, review_id) as rk
    from (select *, unnest(list_filter({_HITS}, lambda x: x is not null)) as target_topic from text_reviews
          where review_id not in (select review_id from text_sample)))
  where rk <= 25)
where first = 1""")


def _boost(s, d):
    reviews = fx.text_reviews(s, d)
    used = cut_lineage(sampling.stratified_sample(reviews).select("review_id"))
    return reviews, used, sampling.keyword_sample(reviews, used, fx.TEXT_TOPIC_PATTERNS)


register("keyword_sample", lambda s, d: _boost(s, d)[2].drop("review_text"), """
select *, 'dev_boost' as split from boost_rows""")


def _churn_sample(s, d):
    reviews, used, boost = _boost(s, d)
    taken = used.unionByName(boost.select("review_id"))
    return sampling.churn_sample(reviews, taken, fx.CHURN_PATTERN).drop("review_text")


register("churn_sample", _churn_sample, f"""
select review_id, app_key, rating, text_length, 'churn_boost' as split from text_reviews
where regexp_matches(lower(review_text), '{fx.CHURN_PATTERN}') and review_id not in (select review_id from text_sample)
  and review_id not in (select review_id from boost_rows)
order by {digest(123, "review_id")}, review_id limit 150""")

# ---------------------------------------------------------------- labels


def _faulty_batch(s, d):
    """The sample, and a batch for it that lost every eleventh record and holds every seventh twice."""
    indexed = cut_lineage(sampling.shuffled_index(_split(fx.text_reviews(s, d)), "review_id", 42))
    kept = _label_batch(s, d, indexed).filter("i % 11 <> 3")
    return indexed, kept.unionByName(kept.filter("i % 7 = 2"))


def _label_batch(s, d, indexed):
    """Label records for the sample, as a labelling pass would return them."""
    topics = fx.table(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), F.array("lang", "source").alias("topics"),
        (F.col("doc_id") % 7 == 0).alias("churn_intent"),
        F.when(F.col("doc_id") % 5 == 0, "betapay").alias("competitor_mentioned"))
    return indexed.select("review_id", "i").join(topics, "review_id").drop("review_id")


def _gold(s, d):
    """Sample, written and re-read label batch, merged labels."""
    indexed = cut_lineage(sampling.shuffled_index(_split(fx.text_reviews(s, d)), "review_id", 42))
    path = scratch_path(s, "label_batch")
    _label_batch(s, d, indexed).write.json(path)
    batch = read_label_batches(s, path, arrays=False)
    return batch, labels.merge_labels(indexed, batch, "ai_v1")


relation("gold", """
select x.*, doc.lang || ';' || doc.source as topics, doc.doc_id % 7 = 0 as churn_intent,
       case when doc.doc_id % 5 = 0 then 'betapay' end as competitor_mentioned, 'ai_v1' as labeler
from text_indexed x join documents doc on cast(doc.doc_id as varchar) = x.review_id""")

_GOLD = ("review_id", "app_key", "rating", "rating_band", "text_length", "stratum", "split", "i", "topics",
         "churn_intent", "competitor_mentioned", "labeler")
register("label_merge", lambda s, d: _gold(s, d)[1].select(*_GOLD), f"select {', '.join(_GOLD)} from gold")


def _integrity(s, d):
    """The checks on a whole batch and on one with lost and doubled records."""
    indexed, faulty = _faulty_batch(s, d)
    whole = _label_batch(s, d, indexed)
    expected = indexed.agg(F.count(F.lit(1))).scalar()
    return (labels.batch_integrity(whole, expected).withColumn("batch", F.lit("whole"))
            .unionByName(labels.batch_integrity(faulty, expected).withColumn("batch", F.lit("faulty"))))


relation("faulty_batch", """
select i from gold where i % 11 <> 3 union all select i from gold where i % 11 <> 3 and i % 7 = 2""")


def _integrity_sql(batch: str, rows: str) -> str:
    return f"""
select '{batch}' as batch, c as "check", v as n_violations, v = 0 as passed from (
  select unnest(['expected_count', 'unique_index', 'contiguous_index']) as c,
         unnest([cast(abs(count(*) - (select count(*) from text_indexed)) as bigint), count(*) - count(distinct i),
                 cast(case when min(i) = 0 and max(i) = count(distinct i) - 1 then 0 else 1 end as bigint)]) as v
  from {rows})"""


register("label_batch_integrity", _integrity, _integrity_sql("whole", "gold") + " union all " + _integrity_sql("faulty", "faulty_batch"))

register("label_frequency", lambda s, d: rounded(labels.label_frequency(_gold(s, d)[0]), "pct"), f"""
select topic, count(*) as n, {dec("100.0 * count(*) / (select count(*) from gold)", 6)} as pct
from (select unnest(string_split(topics, ';')) as topic from gold) group by topic""")

register("flag_rate", lambda s, d: rounded(labels.flag_rate(fx.raw_flags(s, d), "churn_intent"), "positive_share"), f"""
select count(*) as n_rows, count(*) filter (where churn_intent) as n_positive,
       {dec("avg(case when churn_intent then cast(1 as double) else 0 end)", 6)} as positive_share from raw_flags""")


def _spotcheck(s, d):
    return sampling.proportional_sample(_gold(s, d)[1].filter("split = 'test'"))


relation("spotcheck_rows", f"""
select * from (select *, row_number() over (partition by app_key order by {digest(7, "review_id")}, review_id) as rk,
                      round_even(cast(120 as double) * count(*) over (partition by app_key) / count(*) over (), 0) as quota
               from gold where split = 'test') where rk <= quota""")

register("spotcheck_answer_key", lambda s, d: sampling.answer_key(_spotcheck(s, d)),
         "select review_id, topics, churn_intent, competitor_mentioned from spotcheck_rows")

register("spotcheck_blind", lambda s, d: sampling.blind_packet(_spotcheck(s, d), ["en", "de"]), """
select review_id, app_key, rating, review_text, '' as en, '' as de, '' as churn_intent, '' as competitor_mentioned from spotcheck_rows""")

# ---------------------------------------------------------------- agreement

_VOCABULARY = ["good", "toxic", "rare", "unused"]


def _both_labels(s, d):
    """Two label sources for the labelled documents: given labels and a length rule."""
    docs = fx.table(s, d, "documents").select("doc_id", "n_chars")
    both = fx.table(s, d, "labels").join(docs, "doc_id")

    def marks(*pairs):
        return F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in pairs]), lambda x: x.isNotNull())

    key = F.col("doc_id")
    human = both.select("doc_id", marks(("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1),
                                        ("rare", key % 197 == 0)).alias("human"))
    other = both.select("doc_id", marks(("good", F.col("n_chars") >= 400), ("toxic", key % 3 == 0),
                                        ("rare", key % 391 == 0)).alias("other"))
    return human, other


relation("label_cells", """
select v.topic, case v.topic when 'good' then quality = 1 when 'toxic' then toxic = 1 when 'rare' then l.doc_id % 197 = 0 else false end as t,
       case v.topic when 'good' then n_chars >= 400 when 'toxic' then l.doc_id % 3 = 0 when 'rare' then l.doc_id % 391 = 0 else false end as p
from labels l join documents d on l.doc_id = d.doc_id cross join (select unnest(['good', 'toxic', 'rare', 'unused']) as topic) v""")

relation("confusion_rows", """
select *, tp / cast(nullif(tp + fp, 0) as double) as pr, tp / cast(nullif(tp + fn, 0) as double) as rc, 2.0 * tp / nullif(2 * tp + fp + fn, 0) as ff,
       ((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n), 0) as kp
from (select topic, cast(count(*) as double) as n, count(*) filter (where t and p) as tp, count(*) filter (where not t and p) as fp,
             count(*) filter (where t and not p) as fn, count(*) filter (where not t and not p) as tn from label_cells group by topic)""")


def _grid(s, d):
    human, other = _both_labels(s, d)
    merged, _ = labels.merge_checked(human, other, "doc_id")
    return labels.label_grid(merged, _VOCABULARY, "human", "other")


_EMPTY = "tp + fn = 0 and tp + fp = 0"
_NOTE = f"case when {_EMPTY} then '{labels.NOT_SCOREABLE}' when tp + fn >= 5 then '' else '{labels.LOW_SUPPORT}' end"
_AGREE_SQL = f"""select topic, case when not ({_EMPTY}) then {dec("kp", 3)} end as kappa, case when not ({_EMPTY}) then {dec("coalesce(pr, 0)", 3)} end as "precision",
       case when not ({_EMPTY}) then {dec("coalesce(rc, 0)", 3)} end as recall, case when not ({_EMPTY}) then {dec("coalesce(ff, 0)", 3)} end as f1,
       tp + fn as support_human, tp + fp as support_ai, {_NOTE} as note from confusion_rows"""

register("label_agreement", lambda s, d: labels.agreement(labels.confusion(_grid(s, d))), _AGREE_SQL)

register("macro_agreement", lambda s, d: rounded(labels.macro_agreement(
    labels.agreement(labels.confusion(_grid(s, d)))), "macro_kappa", "macro_f1"), f"""
select count(*) as n_scoreable, {dec("avg(kappa)", 6)} as macro_kappa, {dec("avg(f1)", 6)} as macro_f1 from ({_AGREE_SQL}) where kappa is not null""")


def _churn_agreement(s, d):
    marked = fx.table(s, d, "labels").join(fx.table(s, d, "documents").select("doc_id"), "doc_id")
    return labels.flag_agreement(marked.select(F.when(F.col("doc_id") % 7 != 0, F.col("toxic")).alias("human"), (F.col("doc_id") % 3 == 0).alias("other")), "human", "other")


register("churn_agreement", _churn_agreement, f"""
select t as human_positives, p as other_positives, n as n_rows,
       {dec("(cast(n - t - p + 2 * tp as double) / n - e) / nullif(1 - e, 0)", 3)} as kappa
from (select *, (cast(t as double) * p + cast(n - t as double) * (n - p)) / (cast(n as double) * n) as e
      from (select count(*) filter (where h) as t, count(*) filter (where o) as p, count(*) filter (where h and o) as tp, count(*) as n
            from (select coalesce(case when l.doc_id % 7 <> 0 then toxic end, 0) = 1 as h, l.doc_id % 3 = 0 as o from labels l join documents d on l.doc_id = d.doc_id)))""")


def _merge_check(s, d):
    """All documents against the labelled ones, which are fewer: rows are lost."""
    return labels.merge_checked(fx.table(s, d, "documents").select("doc_id"), fx.table(s, d, "labels"), "doc_id")[1]


register("merge_check", _merge_check, """
select n_left, n_merged, abs(n_left - n_merged) as n_violations, n_left = n_merged as passed
from (select (select count(*) from documents) as n_left, (select count(*) from labels l join documents d on l.doc_id = d.doc_id) as n_merged)""")

register("evaluation", lambda s, d: labels.evaluation(labels.confusion(_grid(s, d))), f"""
select topic, tp + fn as support_test, {dec("coalesce(pr, 0)", 3)} as "precision", {dec("coalesce(rc, 0)", 3)} as recall, {dec("coalesce(ff, 0)", 3)} as f1,
       case when tp + fn >= 5 then '' else '{labels.LOW_SUPPORT}' end as note from confusion_rows""")

register("overall_f1", lambda s, d: rounded(labels.overall_f1(labels.confusion(_grid(s, d))),
                                            "macro_f1_all", "macro_f1_supported", "micro_f1"), f"""
select {dec("avg(f)", 6)} as macro_f1_all, {dec("avg(f) filter (where sup >= 5)", 6)} as macro_f1_supported, count(*) filter (where sup >= 5) as n_supported,
       {dec("coalesce(2.0 * sum(tp) / nullif(2.0 * sum(tp) + sum(fp) + sum(fn), 0), 0)", 6)} as micro_f1
from (select *, {dec("coalesce(ff, 0)", 3)} as f, tp + fn as sup from confusion_rows)""")


def _multi_hot(s, d):
    human, _ = _both_labels(s, d)
    return human.select("doc_id", F.array_join(labels.multi_hot(F.col("human"), _VOCABULARY).cast("array<string>"), "").alias("hot"))


register("multi_hot", _multi_hot, """
select l.doc_id, concat(cast(quality = 1 as integer), cast(toxic = 1 as integer), cast(l.doc_id % 197 = 0 as integer), 0) as hot
from labels l join documents d on l.doc_id = d.doc_id""")

_GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]


def _thresholds(s, d):
    scores = fx.table(s, d, "labels").join(fx.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    probability = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    cells = F.array(F.struct(F.lit("good").alias("topic"), F.col("quality").alias("truth"), probability.alias("probability")),
                    F.struct(F.lit("toxic").alias("topic"), F.col("toxic").alias("truth"), (1.0 - probability).alias("probability")))
    return rounded(labels.best_thresholds(scores.select(F.explode(cells).alias("c")).select("c.*"), _GRID), "f1")


register("best_thresholds", _thresholds, f"""
with cells as (select 'good' as topic, quality as truth, n_chars / (n_chars + cast(1000 as double)) as p from labels l join documents d on l.doc_id = d.doc_id
               union all select 'toxic', toxic, 1 - n_chars / (n_chars + cast(1000 as double)) from labels l join documents d on l.doc_id = d.doc_id),
     steps as (select topic, truth, p, cast(unnest([{", ".join(map(str, _GRID))}]) as double) as threshold from cells),
     counted as (select topic, threshold, coalesce(2.0 * count(*) filter (where truth = 1 and p >= threshold) /
                 nullif(count(*) filter (where truth = 1) + count(*) filter (where p >= threshold), 0), 0) as f1 from steps group by 1, 2)
select topic, threshold, {dec("f1", 6)} as f1 from (select *, row_number() over (partition by topic order by f1 desc, threshold) as rk from counted) where rk = 1""")

# ---------------------------------------------------------------- classifiers

_LABELS = [f"topic_{i}" for i in range(10)]


def _vectors(s, d):
    vectors = fx.table(s, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("review_id"), "embedding",
        F.array(F.concat(F.lit("topic_"), F.col("label").cast("string"))).alias("topics"),
        F.col("label").isin(0, 1).alias("churn_intent"), (F.col("vec_id") % 4 == 0).alias("is_test"))
    featured = classifiers.use_embeddings(vectors, "embedding").drop("embedding")
    return featured, classifiers.bounded(featured.filter(~F.col("is_test")), "review_id"), featured.filter("is_test")


relation("vector_rows", "select cast(vec_id as varchar) as id, cast(embedding as double[]) as x, label, vec_id % 4 <> 0 and "
         + newton_sql.kept("(select 1 from embeddings where vec_id % 4 <> 0)", "vec_id") + " as train from embeddings", True)
relation("topics_rows", "select id, x, train from vector_rows")
relation("topics_marks", f"select id, topic, cast(coalesce('topic_' || label = topic, false) as integer) as y from vector_rows cross join (select unnest([{sql_list(_LABELS)}]) as topic) where train")
newton_sql.newton("topics", 64)
relation("churn_rows", "select id, x, train from vector_rows")
relation("churn_marks", "select id, 'positive' as topic, cast(coalesce(label in (0, 1), false) as integer) as y from vector_rows where train")
newton_sql.newton("churn", 64)
_TOPIC_SQL = f"select id as review_id, topic, {dec('p', 6)} as probability from topics_chance where p >= 0.5"


def _topic_scores(s, d):
    everything, train, _ = _vectors(s, d)
    model = classifiers.fit_topics(train, _LABELS)
    return rounded(classifiers.positive_topics(classifiers.topic_probabilities(model, everything)), "probability")


register("topic_scores", _topic_scores, _TOPIC_SQL)


def _saved_topic_scores(s, d):
    """The same scores from a model that was saved, listed and loaded: a job that fits nothing."""
    everything, train, _ = _vectors(s, d)
    folder = scratch_path(s, "models")
    for rows in (train.filter("topics[0] <> 'topic_9'"), train):       # the later version counts
        classifiers.save_version(s, Pipeline(stages=[classifiers.TopicClassifier(topics=_LABELS)]).fit(rows), folder, rows.count())
    model = classifiers.load_version(s, folder)
    return rounded(classifiers.positive_topics(classifiers.topic_probabilities(model.stages[-1], everything)), "probability")


register("saved_topic_scores", _saved_topic_scores, _TOPIC_SQL)


def _churn_scores(s, d):
    everything, train, _ = _vectors(s, d)
    return rounded(classifiers.churn_flags(classifiers.fit_binary(train, F.col("churn_intent")), everything), "churn_probability")


register("churn_scores", _churn_scores, f"select id as review_id, p >= 0.5 as churn_intent, {dec('p', 6)} as churn_probability from churn_chance")


def _held_out(s, d):
    _, train, test = _vectors(s, d)
    model = classifiers.fit_topics(train, _LABELS)
    scored = classifiers.topic_probabilities(model, test, ("review_id", "topics"))
    grid = scored.select("topic", F.coalesce(F.array_contains("topics", F.col("topic")), F.lit(False)).cast("int").alias("truth"),
                         (F.col("probability") >= 0.5).cast("int").alias("predicted"))
    return labels.evaluation(labels.confusion(grid))


register("held_out_scores", _held_out, f"""
select topic, support_test, {dec("coalesce(tp / cast(nullif(tp + fp, 0) as double), 0)", 3)} as "precision", {dec("coalesce(tp / cast(nullif(support_test, 0) as double), 0)", 3)} as recall,
       {dec("coalesce(2.0 * tp / nullif(tp + fp + support_test, 0), 0)", 3)} as f1, case when support_test >= 5 then '' else '{labels.LOW_SUPPORT}' end as note
from (select topic, count(*) filter (where t) as support_test, count(*) filter (where t and p >= 0.5) as tp, count(*) filter (where not t and p >= 0.5) as fp
      from (select c.topic, c.p, coalesce('topic_' || v.label = c.topic, false) as t from topics_chance c join vector_rows v using (id) where cast(id as bigint) % 4 = 0) group by 1)""")

_BUCKETS = 64


def _texts(s, d):
    return fx.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_text"), F.array("lang").alias("topics"))


relation("spaced_texts", r"""
select cast(doc_id as varchar) as id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')) || ' ' as t from documents""", True)
relation("text_letters", """
select id, c, lead(c, 1) over (partition by id order by place) as c2, lead(c, 2) over (partition by id order by place) as c3
from (select id, unnest(string_split(t, '')) as c, generate_subscripts(string_split(t, ''), 1) as place from spaced_texts)""")
relation("text_grams", """
select id, kind, gram, count(*) as n from (
  select id, 'c' as kind, c || c2 as gram from text_letters union all select id, 'c', c || c2 || c3 from text_letters
  union all select id, 'w', unnest(string_split(trim(t, ' '), ' ')) from spaced_texts) where gram <> '' group by 1, 2, 3""", True)
relation("text_buckets", f"""
select id, ('0x' || h[1:8])::bigint % {_BUCKETS} as bucket, sum(case when h[9] < '8' then n else -n end) as v
from (select id, n, md5(kind || ':' || gram) as h from text_grams) group by 1, 2""", True)
relation("text_features", "select id, bucket, v / sqrt(sum(v * v) over (partition by id)) as v from text_buckets where v <> 0", True)
relation("languages_rows", f"""
select s.id, list(coalesce(f.v, 0) order by b) as x, bool_and(cast(s.id as bigint) % 4 <> 0 and {newton_sql.kept("(select 1 from documents where doc_id % 4 <> 0)", "s.id")}) as train
from spaced_texts s cross join (select unnest(range(0, {_BUCKETS})) as b) left join text_features f on f.id = s.id and f.bucket = b group by 1""", True)
relation("languages_marks", "select r.id, topic, cast(coalesce(lang = topic, false) as integer) as y from languages_rows r join spaced_texts using (id) cross join (select unnest(['de', 'en', 'es', 'fr']) as topic) where train")
newton_sql.newton("languages", _BUCKETS)


def _text_features(s, d):
    """Hashed words and character n-grams of every text, by a saved and loaded encoder."""
    path = scratch_path(s, "encoder")
    classifiers.text_encoder(n_features=_BUCKETS).fit(_texts(s, d)).write().save(path)
    encoded = classifiers.encode_text(PipelineModel.load(path), _texts(s, d))
    # Of a plain explode Spark infers that the array has items, and encodes each text once more to test that first.
    return rounded(encoded.select("review_id", F.posexplode_outer("features").alias("bucket", "value")).filter("value <> 0"), "value")


register("text_features", _text_features, f"select id as review_id, cast(bucket as integer) as bucket, {dec('v', 6)} as value from text_features")


def _text_topics(s, d):
    """Language of each document from hashed words and character n-grams, trained on three quarters."""
    encoded = cut_lineage(classifiers.encode_text(classifiers.text_encoder(n_features=_BUCKETS).fit(_texts(s, d)), _texts(s, d)).drop("review_text"))
    train = classifiers.bounded(encoded.filter(F.col("review_id").cast("bigint") % 4 != 0), "review_id")
    model = classifiers.fit_topics(train, ["de", "en", "es", "fr"])
    return rounded(classifiers.positive_topics(classifiers.topic_probabilities(model, encoded)), "probability")


register("text_topic_scores", _text_topics, f"select id as review_id, topic, {dec('p', 6)} as probability from languages_chance where p >= 0.5")


def _leakage(s, d):
    reviews, used, boost = _boost(s, d)
    split = _split(reviews)
    parts = [split.filter("split = 'dev'").select("review_id"), boost.select("review_id")]
    return classifiers.assemble_training(parts, split.filter("split = 'test'"))[1]


register("leakage_check", _leakage, """
select count(*) as n_leaked, count(*) = 0 as passed
from (select review_id from text_split where split = 'dev' union all select review_id from boost_rows) t
where review_id in (select review_id from text_split where split = 'test')""")
