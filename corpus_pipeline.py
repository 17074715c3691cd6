"""A corpus pipeline over ``documents``: good, distinct, uncontaminated, redacted, encoded.

Every stage takes what the stage before it kept, as a table, and its decisions take
effect there: rows go, or their texts change. Null and empty texts, repeated rows and
empty tables have the results that each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import bpe, decontaminate, jaccard, pii, quality
from tagloom.llm.common import table
from tagloom.plans.shared import through_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where(quality.fold_of(4) != 2))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by shingles of five words and 0.8, the document with the smallest id."""
    return jaccard.one_of_each(docs, 5, 80)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in place of personal data."""
    return pii.redact(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    coded = bpe.encode(docs.withColumn("digest", digest), ranks, public_tokenizers.PATTERN, ("doc_id", "lang", "source", "digest"))
    return bpe.decode(coded.withColumn("ids_kept", F.col("ids")), ranks).select(
        "doc_id", "lang", "source", F.size("ids_kept").cast("long").alias("n_tokens"), F.col("ids_kept").alias("ids"),
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("PII", private_documents),
    ("byte-level BPE encoding and decoding", encoded_documents),
]

#: No stage but the join can be said in SQL; the tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
