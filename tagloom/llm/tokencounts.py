"""Token counts behind a digest cache.

Contents are known by their SHA-256, the tokenizer by a digest of its file. Counts that
the cache holds are joined; of the rest, each distinct content is encoded once and
appended to the cache. Contents are normalised only by what cannot change a count: null
is the empty text.

Defined results: empty and null texts have no bytes and the count of the empty text;
repeated rows are counted once and reported as often as they come; a null ``doc_id``
stays null; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table
from .common import map_arrow, text_of, text_slices

CACHE = "digest binary, version binary, n_tokens long"


def version_of(model: str) -> bytes:
    """Digest of the tokenizer's file: another file never finds this one's counts."""
    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _encoder(model: str):
    """``texts -> counts`` by the library that the file's name asks for."""
    if model.endswith(".json"):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _counter(model: str, version: bytes):
    def make():
        encode = _encoder(model)

        def run(batch: pa.RecordBatch):
            for part, texts in text_slices(batch):
                counts = encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array([version] * len(counts), pa.binary()), pa.array(counts, pa.int64())],
                    ["digest", "version", "n_tokens"])
        return run
    return make


def open_cache(spark, path: str) -> DataFrame:
    """The stored counts; a cache without any file yet is empty."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, model: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; appends to ``cache``.

    Texts cross the network once, hashed by row so that no content is hot, and only to
    meet the rows chosen to be encoded. ``model`` must be readable at that path on all
    machines, as the tokenizer libraries ask.
    """
    spark = docs.sparkSession
    version = version_of(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = through_table(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "counts")
    known = open_cache(spark, cache).where(F.col("version") == F.lit(bytearray(version))).select("digest", "n_tokens")
    chosen = narrow.groupBy("digest").agg(F.min("doc_id").alias("of")).join(known, "digest", "left_anti")
    chosen = chosen.withColumnRenamed("digest", "wanted").hint("shuffle_hash")
    missed = keyed.join(chosen, keyed.doc_id.eqNullSafe(chosen.of) & (keyed.digest == chosen.wanted), "left_semi")
    # A row that is there twice under one id is encoded twice; the cache keeps one of its counts.
    counted = map_arrow(missed.select("digest", "text"), _counter(model, version), CACHE)
    fresh = counted.groupBy("digest", "version").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache)
    counts = open_cache(spark, cache).where(F.col("version") == F.lit(bytearray(version))).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return narrow.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
