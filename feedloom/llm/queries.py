"""The registered queries of this folder and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontamination, extraction, jaccard, langid, mixing, phrases, substrings, suffixes, tokencount, tokenfile, vectors, warc, whitening
from feedloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            STATEMENTS[name] = sql
        return f
    return keep


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as ticket from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from sources),
weighed as (select *, ([5.0, 2.0, 1.0]::double[])[rank % 3 + 1] as weight, 2.0::double * source_size as cap from ranked),
levels as (
  select *, cap / weight as ratio,
         (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as lvl from weighed),
chosen as (select *, first_value(case when ratio >= lvl then lvl end ignore nulls) over (order by ratio, rank rows between unbounded preceding and unbounded following) as water from levels),
aims as (select source, source_size, rank, case when water is null then cap else least(cap, water * weight) end as target from chosen),
queue as (
  select d.*, a.source_size, a.rank, a.target, sum(d.size) over (partition by a.rank order by d.ticket, d.doc_id, d.size rows unbounded preceding) as cum
  from sized d join aims a on d.source is not distinct from a.source),
turns as (select q.*, t.turn, (cum + turn * source_size)::double / target as finish from queue q, (values (0), (1)) t(turn) where size > 0),
served as (select *, sum(size) over (order by finish, rank, turn, ticket, doc_id, size rows unbounded preceding) as used from turns),
taken as (select doc_id, ticket, sum(case when used <= (select 1.5::double * sum(source_size) from sources) then size else 0 end)::bigint as taken from served group by 1, 2)
select q.doc_id, q.source, q.size, q.source_size, round(q.target, 6) as target, coalesce(t.taken, 0)::bigint as taken
from queue q left join taken t on q.doc_id is not distinct from t.doc_id
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark, sf_dir):
    from pyspark.sql import functions as F

    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op8_token_counts")
def op8(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op5_token_files")
def op5(spark, sf_dir):
    return tokenfile.encoded_index(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    return substrings.dedup_windows(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


COSINE_SQL = """
with recursive given as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from given a join given b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
reach as (select vec_id as id, vec_id as low from embeddings union select l.b, r.low from reach r join links l on l.a = r.id),
low as (select id, min(low) as component_id from reach group by id),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, low.component_id, e.vec_id = low.component_id as kept
from embeddings e join low on low.id = e.vec_id left join degree d on d.a = e.vec_id
"""


@query("op10_vector_near_dups", COSINE_SQL)
def op10(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from worded),
tokens as (select doc_id, unnest(s) as t from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
reach as (select doc_id as id, doc_id as low from sets union select l.b, r.low from reach r join links l on l.a = r.id)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.low) as component_id from sets s join reach r on r.id = s.doc_id group by 1, 2
"""


@query("op9_jaccard_components", JACCARD_SQL)
def op9(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


PHRASE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, m as n, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from worded, (values (1), (2), (3)) t(m) where len(w) >= m),
counted as materialized (select lang, n, phrase, count(*) as f, lang || chr(10) || phrase as key from grams group by lang, n, phrase),
totals as (select lang, sum(f)::bigint as n from counted where n = 1 group by 1),
frequent as materialized (select *, string_split(phrase, ' ') as w from counted where f >= 10),
parted as (select *, unnest(range(1, n)) as k from frequent where n >= 2),
cuts as (
  select c.lang, c.phrase, c.n as len, c.f as a, k, l.f as l, r.f as r, ((1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f))::bigint as score
  from parted c join frequent l on l.key = c.lang || chr(10) || array_to_string(c.w[1:k], ' ')
  join frequent r on r.key = c.lang || chr(10) || array_to_string(c.w[k + 1:], ' ')),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (
  select lang, array_to_string(w[s:s + 1], ' ') as phrase, max(f) as longer from (select *, unnest([1, 2]) as s from frequent where n = 3) group by 1, 2),
kept as (select w.* from weakest w left join inner_phrases i on w.lang = i.lang and w.phrase = i.phrase where i.longer is null or 100 * i.longer < 50 * w.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n, score
from kept k join totals t on t.lang = k.lang qualify rank <= 2000
"""


@query("op13_phrase_collocations", PHRASE_SQL)
def op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


# five hexadecimal digits are four of base 32
ARCHIVE_SQL = """
with sized as (select page_id, coalesce(html, '') as payload from pages),
keyed as (select page_id, octet_length(encode(payload))::bigint as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by payload) as first_page from sized),
digits as (select *, list_transform(range(0, 8), lambda g: ('0x' || hex[5 * g + 1:5 * g + 5])::bigint) as v from keyed)
select page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> s) & 31) + 1]), '')), '') as payload_digest,
       case when page_id = first_page then 'response' else 'revisit' end as record_type, case when page_id <> first_page then first_page end as refers_to
from digits
"""


@query("op11_warc_bundles", ARCHIVE_SQL)
def op11(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
