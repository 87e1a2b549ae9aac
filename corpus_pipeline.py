"""The corpus pipeline: language ID, near-dedup, personal data, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, langid, minhash, mixing, pii
from spanloom.llm.shared import stored, table

LEAST_SCORE = 0.1
SIMILARITY_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no letters, or n-grams as far as can be from every profile.

    Null and empty texts go, repeated rows are judged alike, ties go to the first
    language by name; an empty table stays empty. Profiles come from the labelled
    documents outside the held-out fifth.
    """
    profiles = langid.learn_profiles(docs.where(~langid.is_held_out() & F.col("doc_id").isNotNull()))
    found = langid.predict_language(docs, profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates, that of the smallest doc_id.

    Rows that repeat a doc_id are one document, of which the row with the least
    text stays. Documents without a text or without a doc_id are no duplicates
    of any and stay; an empty table stays empty.
    """
    kept = minhash.near_duplicates(docs, percent=SIMILARITY_PERCENT).where("kept").select("doc_id")
    unique = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.take(1):
        again = unique.join(twice, "doc_id", "left_semi")
        one = again.groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("r"))
        one = one.select(*(F.col("doc_id") if c == "doc_id" else F.col("r")[c].alias(c) for c in docs.columns))
        unique = unique.join(twice, "doc_id", "left_anti").select(*docs.columns).union(one)
    return unique.union(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and counts their characters anew.

    All rows stay: null and empty texts as they are, repeated rows masked alike;
    overlapping spans become one mask; an empty table stays empty.
    """
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents to the target weights of domains, languages and sources, none more than once.

    Null languages and sources are values of their own; null and empty texts
    have no tokens and come with the prefix they fall into; rows of one doc_id
    go by text; an empty table stays empty.
    """
    return mixing.mix(docs, epochs=1).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces texts by their token ids, and adds their number. Null and empty texts have none; repeated rows are each encoded."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_pieces=50_000, remember=False)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixture),
    ("bpe", token_ids),
]

#: Language profiles, similarity joins and merges have no SQL form; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
