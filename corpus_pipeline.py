"""From raw documents to a tokenised training mix.

Toxic documents go, then exact copies, then near copies; what is left is drawn by the sources' target weights and encoded.
Every stage works on all that the one before kept, takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millwatch.llm import bpe, exact, jaccard, mixing, toxicity
from millwatch.llm.tables import ARROW_ROWS, stored, table
from millwatch.session import ship_package

VOCABULARY = "word_bpe_49k.json"
#: Whole texts that a Python worker gets at once, and bytes of text that it works on together.
TEXTS_AT_ONCE, BLOCK, BPE_BLOCK = 1_000, 1 << 19, 1 << 20


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set(ARROW_ROWS, str(TEXTS_AT_ONCE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on ``labels``, does not reject."""
    _ready(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), block=BLOCK)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    _ready(spark)
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are five-word shingle sets with a similarity of 0.8 or more."""
    _ready(spark)
    return jaccard.one_of_each(docs, size=5, similar=(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    _ready(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document: doc_id, n_tokens, ids."""
    _ready(spark)
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), block=BPE_BLOCK)


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode),
]

#: A trained model, sampling trees and merge tables have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
