"""A training-data pipeline over documents: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm import bpe, jaccard, mixing, quality, toxicity
from winnowry.llm.common import discard, fold, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under their language's calibrated threshold (0.7 for languages without one); learnt from labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    return docs.where(~toxicity.flag_of(model, toxicity.score_of(model, F.col("text")), F.col("lang")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's and source's statistics."""
    return quality.accepted(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles and a similarity of 0.8 or more."""
    return jaccard.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of the decoded text."""
    return bpe.bpe(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("n-gram Jaccard join", one_per_group), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: A trained classifier and hash thresholds are beyond SQL; the operators are tested one by one in tests/llm/test_operators.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)  # the table itself is no materialised frame and stays
    return STAGES[-1][1](spark, docs, sf_dir)
