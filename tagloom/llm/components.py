"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (its component's smallest node) of every node of ``edges`` (a, b).

    Each round takes the least label among the neighbours, then the label of that label,
    so the rounds grow with the logarithm of the longest path. Rounds end in a table;
    only the number of changed rows comes to the driver.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = through_table(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = through_table(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = through_table(lower.join(ahead, F.col("label") == F.col("at"), "left").select(
            "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
