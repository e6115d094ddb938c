"""Corpus pipeline: quality classifier, exact dedup, near dedup, source mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  Stages that run Python set the size of Arrow batches of their
session; as they return plans that run later, the setting stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospecta.llm import exact_dedup, mixing, piece_bpe, simhash, weak_quality
from prospecta.llm.common import BATCH, materialize, small_batches  # noqa: F401
from prospecta.llm.queries import documents, model_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    small_batches(spark)
    return weak_quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and digest of its token ids, and the digest of the decoded text."""
    small_batches(spark)
    return piece_bpe.coded(docs, model_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL has neither the classifier nor fingerprints nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
