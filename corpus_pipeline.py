"""From raw documents to packed training sequences, in four stages that each call one operator.

quality_rules      documents whose words, repeats or compression fail the rules go
quality_classifier documents scored below the threshold go; fitted on the labelled documents that are left
near_dedup         one document of each SimHash component stays
packing            the rest becomes pieces placed in sequences of at most 1024 tokens

A stage gets all that its predecessor kept and returns the same columns; the last returns the placed pieces.
Null or empty texts fail the word rule; an empty table gives empty results; other columns pass untouched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import packing, quality_classifier, quality_rules, simhash
from credence.llm.common import stored, table
from credence.llm.queries import vocabulary


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", dedup_stage),
    ("packing", packing_stage),
]

#: Fingerprints, fitted scores and searched packings have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
