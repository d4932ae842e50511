"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; its result is written as Parquet and read again.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from orderlens.llm.common import SharedFolder, documents

#: A text stays in the language stage unless it has no letter or no language's
#: regression comes near to a yes (0.5 is neither yes nor no).
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; the labels outside the held-out fold are learned from."""
    model = language_id.trained_model(docs)
    return language_id.identify(docs, model, least_score=LEAST_LANGUAGE_SCORE).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts (five-word shingles, 80 %)."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The sketches of near-dedup and the merges of BPE have no SQL equivalent here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = SharedFolder(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = folder.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            folder.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
