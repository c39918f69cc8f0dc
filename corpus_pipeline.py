"""A corpus pipeline of the text operators: quality rules, near-dedup, PII, mixing, packing.

``STAGES`` are applied in order; each gets what the one before kept, written and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfprice.llm import mixing, near_dedup, packing, pseudonyms, quality_rules
from shelfprice.llm.queries import PSEUDONYM_KEY, tokenizer_path
from shelfprice.operators.staging import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private strings replaced."""
    return pseudonyms.replace_in(docs, PSEUDONYM_KEY)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", good_quality),
    ("near_dedup", without_near_copies),
    ("pseudonyms", with_pseudonyms),
    ("mixing", in_proportion),
    ("packing", in_sequences),
]

#: SQL cannot express near-dedup by sampling, keyed pseudonyms and the linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
