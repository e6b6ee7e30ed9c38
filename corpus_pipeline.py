"""A training corpus from raw documents: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last keep the columns of documents. No stage caps or samples rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import op1_perfect_hash_dedup, op5_simhash_trie, op6_vector_packing, op8_mix_sources, op10_string_kernel_language
from parcelflow.llm.common import documents, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have no language, null texts and texts without a letter; a null ``lang`` gets the predicted one."""
    return op10_string_kernel_language.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return op1_perfect_hash_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose SimHash fingerprints are linked keep one row, that of the smallest doc_id; rows are known by id and text."""
    return op5_simhash_trie.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target."""
    return op8_mix_sources.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place."""
    return op6_vector_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL expresses neither the language model, nor the fingerprints, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
