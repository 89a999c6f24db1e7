"""From raw documents to token ids: quality, language, near duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
All stages but the last return the columns of documents; rows with null ids, null texts or further columns are allowed,
as said by the operator of each stage. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfinder.llm import bpe, language, mixing, ngram_join, quality
from twinfinder.llm.common import fold, table
from twinfinder.llm.settings import GOOD, MIXTURE, RANKS, SURE_LANGUAGE, bpe_digests, mix_levels
from twinfinder.session import checkpointed, configure


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without words, and those whose probability of good quality is below GOOD."""
    configure(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.quality_model(docs, labels)
    return docs.filter(quality.quality_of(model) >= GOOD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in no language: without a letter, or not like any language that was learned."""
    configure(spark)
    network = language.language_model(docs, fold("doc_id") > 0, outside=True)
    if not network.languages:
        return docs
    found = language.language_of(network, "text")
    # The share of no language is the score of `und`, which is 0 without a letter. One column, so that the text is scored once.
    inside = (found["score"] > 0) & (found["score"] <= 1 - SURE_LANGUAGE)
    return docs.filter(F.when(found["lang"] != language.UNKNOWN, True).otherwise(inside))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    configure(spark)
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their domain, language and source; once for every epoch of theirs."""
    configure(spark)
    return mixing.mix(docs, mix_levels(), MIXTURE).drop("mix_epoch")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and the digest of what they decode to."""
    configure(spark)
    return bpe_digests(bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path(RANKS)))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", tokens),
]

# Trained models decide in the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; every result but the last is stored before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
