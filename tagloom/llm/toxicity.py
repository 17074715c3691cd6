"""Toxicity: subword-bag embeddings averaged into a linear softmax, see ``embeddings``.

Words are lower-cased. Character n-grams of three to six letters let an unseen spelling
share most of its vectors with the word it was made from.

Defined results: null and empty texts get the score of an empty mean, the classifier's
bias; labels that are null or without a document are passed over; repeated rows give
repeated results; without any label every score is 1/2; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import embeddings
from .quality import fold_of

FEATURES = embeddings.Features(bits=18, shortest=3, longest=6, pairs=False, fold=True)
TRAINING = embeddings.Training(most=6144, batch=32, telling=4.0, rest=0.03)
THRESHOLD = 0.5


def classify(docs: DataFrame, labels: DataFrame, how: embeddings.Training = TRAINING,
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows outside fold 0 of 5 only."""
    held_out = fold_of(5) == 0
    model = embeddings.fit(docs, labels.where(~held_out), "toxic", FEATURES, how)
    return embeddings.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
