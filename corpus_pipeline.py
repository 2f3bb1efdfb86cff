"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, PII surrogates, packing.

STAGES are run in order over `documents`; each stage's result is written as Parquet to the shared
folder and read again as the next one's input. A stage judges only its own input. All but the last
return the columns of documents, whatever other columns these have. An empty table gives an empty
result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnspark.llm import packing, quality_rules, simhash, substring_dedup, surrogates
from learnspark.llm.common import cut, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go, null and blank texts among them; repeated ids are judged row by row."""
    small_batches(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays, a null id first; of equal (id, text) rows one."""
    small_batches(spark)
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 20-word sequences that occur in a smaller doc_id, or earlier in the same document, go; null texts stay null."""
    small_batches(spark)
    return substring_dedup.remove_repeats(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates under the secret spark.learnspark.key, the same one everywhere; where it is unset, one is drawn for the session; null texts stay null."""
    return surrogates.with_surrogates(docs, surrogates.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in a training sequence; a null text is its end token alone."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("substring_dedup", repeats),
    ("pii_surrogates", pii),
    ("packing", pack),
]

#: SQL cannot express fingerprints, certified cutoffs or tokenizers; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
