"""The corpus pipeline: raw documents to token-id files, each stage one operator of feedloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontamination, jaccard, langid, mixing, tokenfile
from feedloom.llm.common import table, written
from feedloom.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language, as learnt from the labels of those that aren't held out."""
    model = langid.train(docs.where(~langid.held_out()))
    # a given column of a name that the prediction adds keeps its values
    aside = {c: f"_given_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    known = langid.predict(docs.withColumnsRenamed(aside), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest id; rows without an id are told apart by their texts."""
    return jaccard.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token-id files: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.encoded_index(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token files", token_files)]

#: The string-kernel classifier and the tokenizer can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
