"""Comparison of a downloaded table with the local one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tags import content_digest

MATCHED, CLASH, NEW = "matched", "clash", "new"


def _local_contents(local: DataFrame) -> DataFrame:
    """Distinct contents, 32 bytes each. Copies collapse before the exchange."""
    return local.select(content_digest().alias("_content")).distinct()


def _local_ids(local: DataFrame) -> DataFrame:
    return local.select("tid").where("tid is not null").distinct()


def diff_tags(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every incoming row with its ``status``.

    matched: the same content is stored locally, under whichever key; clash: it is not,
    but its key is taken; new: neither. Copies among the incoming rows all stay. With
    an empty local table everything is new.

    Both lookups are left joins with unique narrow keys, so the incoming side is never
    multiplied and a hot content or key on it can be split by adaptive execution.
    """
    seen = _local_contents(local).withColumn("_seen", F.lit(True))
    taken = _local_ids(local).withColumn("_taken", F.lit(True))
    return (
        incoming.withColumn("_content", content_digest())
        .join(seen, "_content", "left")
        .join(taken, "tid", "left")
        .withColumn("status", F.when(F.col("_seen"), MATCHED)
                    .when(F.col("_taken"), CLASH).otherwise(NEW))
        .select(*incoming.columns, "status")
    )


def diff_new(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose content is not stored locally, key clashes included."""
    return (incoming.withColumn("_content", content_digest())
            .join(_local_contents(local), "_content", "left_anti").select(*incoming.columns))


def diff_clash(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of those, the rows whose key is taken locally."""
    return diff_new(local, incoming).join(_local_ids(local), "tid", "left_semi").select(
        *incoming.columns)


def diff_summary(diff: DataFrame) -> DataFrame:
    """(new, clash, matched, total, matched_pct) of a table with a ``status``."""
    def count(status: str):
        return F.count_if(F.col("status") == status)

    total = F.count(F.lit(1))
    return diff.agg(
        count(NEW).alias("new"), count(CLASH).alias("clash"), count(MATCHED).alias("matched"),
        total.alias("total"),
        F.round(F.lit(100.0) * count(MATCHED) / F.nullif(total, F.lit(0)), 1).alias("matched_pct"))
