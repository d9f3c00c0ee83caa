"""Documents to packed training sequences: host rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last keep the columns of
documents. Packing has no SQL form, nor have the stages before it, so ORACLE_SQL is None and tests compare each stage
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import _shared, bagminhash, feistel_pii, host_rules, packing, suffix_dedup
from lodestar.llm.bpe import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return feistel_pii.replace_pii(docs, feistel_pii.session_key(spark))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_tokenizer(), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
