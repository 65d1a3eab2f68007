"""The corpus pipeline: five stages over documents, each by an operator of ledgerline.llm.

Language ID drops texts that have no letter or no language of at least half their letters; SimHash
near-dedup keeps one document of each group; suffix-array dedup cuts repeated bytes out of texts;
decontamination drops documents that hold a benchmark item; BPE gives the token digests of what is
left. Each stage reads the Parquet table that the one before it wrote, and limits the batches that
Spark sends to Python workers, where the session has no limit (common.small_batches). Nulls, empty texts, repeated
rows and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, common, decontaminate, langid, simhash, suffix_dedup

#: Share of a text's letters that its language has at least.
LANGUAGE_SHARE = 0.5
#: Words of a repeated passage that the third stage removes, and the bytes by which it looks for them:
#: four a word with its space, fewer than nearly all prose of 50 words has.
PASSAGE, PASSAGE_BYTES = 50, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; learned from the rows that have a label."""
    common.small_batches(spark)
    model = langid.fit(docs, F.lit(True))
    if not model.languages:  # nothing to learn from: no decision
        return docs
    lang, score = common.fresh(docs, "lang", "score")
    named = langid.identify(docs, model, (lang, score))
    return named.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    common.small_batches(spark)
    return simhash.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of PASSAGE words or more that are elsewhere, too."""
    common.small_batches(spark)
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    common.small_batches(spark)
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each row."""
    common.small_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: SQL expresses neither the trained model nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.scratch(docs, name)
    return docs
