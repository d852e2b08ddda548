"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again.

Language ID drops texts without a recognisable language, exact dedup keeps one row of each
text, MinHash near-dedup keeps one document of each group (five words, similarity of 0.8 and
more), personal data is replaced in the texts, and packing cuts what is left into sequences.
All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, langid, minhash, packing, pii
from millrace.llm.bpe import vocabulary
from millrace.llm.common import documents, drop, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.sure_language(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_copies(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller caches and batches than the operator's own: what earlier stages left in an
    # executor stands beside them
    return packing.packed(docs, vocabulary(packing.VOCABULARY), cache=60_000, most=1 << 20)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: The stages are not expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
