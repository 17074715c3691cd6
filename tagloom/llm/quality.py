"""Quality classifier: supervised subword embeddings, see ``embeddings``.

Words keep their case and their marks, as shouting and noise show in them.

Defined results: null and empty texts get the score of an empty mean, the classifier's
bias; labels that are null or without a document are passed over; repeated rows give
repeated results; without any label every score is 1/2; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import embeddings

FEATURES = embeddings.Features(bits=17, shortest=3, longest=5, pairs=True)
TRAINING = embeddings.Training(most=2048)
THRESHOLD = 0.7


def fold_of(count: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``count``."""
    return F.crc32(F.col(column).cast("string")) % count


def fit(docs: DataFrame, labels: DataFrame, how: embeddings.Training = TRAINING) -> embeddings.Model:
    return embeddings.fit(docs, labels, "quality", FEATURES, how)


def classify(docs: DataFrame, labels: DataFrame, how: embeddings.Training = TRAINING,
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows outside fold 2 of 4 only."""
    held_out = fold_of(4) == 2
    model = fit(docs, labels.where(~held_out), how)
    return embeddings.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns.

    Rows are scored where they are read: nothing is joined back or shuffled.
    """
    model = fit(docs, labels)
    return embeddings.score_rows(docs, model, "llm_score").where(F.col("llm_score") >= threshold).drop("llm_score")
