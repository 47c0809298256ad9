"""A corpus from documents to token ids: toxic documents and repeated lines go, near copies too, sources are mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemolith.llm.common import cut, documents, labels
from mnemolith.llm.op1_line_dedup import dedup_lines
from mnemolith.llm.op4_near_dedup import keep_one
from mnemolith.llm.op5_toxicity import drop_toxic, train_toxicity
from mnemolith.llm.op6_sentencepiece import default_model, piece_digests
from mnemolith.llm.op10_mixing import take_mixture
from mnemolith.session import prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled documents of ``sf_dir``."""
    prepare(spark)
    return drop_toxic(docs, train_toxicity(documents(spark, sf_dir), labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; those left without any line go."""
    prepare(spark)
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return keep_one(docs, threshold=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    prepare(spark)
    return take_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture."""
    prepare(spark)
    return piece_digests(docs, default_model())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Classifier and random rounding are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
