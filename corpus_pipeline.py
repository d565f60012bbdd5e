"""The corpus pipeline: toxicity, language, near duplicates, benchmark passages, token ids, in this order.

Each stage works on all that the one before it kept, and its decisions take effect: what it rejects is gone.  All but the last
return the columns of documents; the last gives each document's number of ids and the digests of its ids and decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, common, decontaminate, langid, ngram_join, toxicity
from tidelog.llm.queries import pattern, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; labels are learned from the rows that op10 learns from."""
    return toxicity.keep(docs, common.table(spark, sf_dir, "labels"), common.remainder(3) != 1)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep(docs, common.remainder(4) != 2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.keep(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), carry=("lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trained models and exact joins; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
