"""Counts, update statistics, top tags, duplicates and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import diff_days, fmt_mdwhm
from ..functions.tags import device_tags, plain_tags
from ..plans.ordered import moving_average, running_max

# How many update times are reported, how many tags each, slow limit in ms.
REPORTED_TIMES = 11
REPORTED_TAGS = 3
SLOW_MS = 333


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, max_tid) of each table; the maximum is null where there is no key."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"),
               (F.max("tid") if "tid" in df.columns else F.lit(None)).cast("bigint").alias("max_tid"))
        .select(F.lit(name).alias("name"), "n", "max_tid")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def max_tid(tags: DataFrame) -> DataFrame:
    return tags.agg(F.max("tid").alias("max_tid"))


def last_by_dt(tags: DataFrame) -> DataFrame:
    """The row with the latest time; the largest key when several share it."""
    return (tags.where("dt is not null")
            .orderBy(F.desc("dt"), F.desc_nulls_last("tid")).limit(1))


def count_by_ref_type(tags: DataFrame) -> DataFrame:
    return tags.groupBy("ref", "type").agg(F.count(F.lit(1)).alias("n"))


def duplicate_report(tags: DataFrame) -> DataFrame:
    """(ref, type) pairs that occur more than once, with their time span."""
    return (tags.groupBy("ref", "type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
            .where("n > 1"))


def distinct_dt_desc(tags: DataFrame, k: int = REPORTED_TIMES) -> DataFrame:
    return tags.select("dt").where("dt is not null").distinct().orderBy(F.desc("dt")).limit(k)


def update_stats(tags: DataFrame, now, k: int = REPORTED_TIMES) -> DataFrame:
    """The newest k update times: rows, largest key, age of the newest, text of lone rows.

    Times are counted without touching the text. Only for times with a single row the
    text is fetched afterwards, through a join with those at most k rows.
    """
    times = (tags.where("dt is not null").groupBy("dt")
             .agg(F.count(F.lit(1)).alias("n"), F.max("tid").alias("max_tid"))
             .orderBy(F.desc("dt")).limit(k))
    # At most k rows by the limit above. Both columns are kept, so that the counting is
    # shared with `times` and not done again.
    lone = times.where("n = 1").select(F.col("dt").alias("at"), "max_tid")
    same = (F.col("dt") == F.col("at")) & F.col("tid").eqNullSafe(F.col("max_tid"))
    detail = (tags.select("tid", "dt", "type", "txt", "sts").join(F.broadcast(lone), same, "left_semi")
              .select("dt", F.concat(
                  F.col("type"), F.lit(": "), F.col("txt"),
                  F.coalesce(F.array_join(F.transform("sts", lambda t: F.concat(F.lit(" #"), t)), ","),
                             F.lit(""))).alias("detail")))
    newest_dt = F.max("dt").over(Window.partitionBy())  # over the k rows of `times`
    return (times.join(detail, "dt", "left")
            .select("dt", fmt_mdwhm(F.col("dt")).alias("shown"), "n", "max_tid",
                    diff_days(F.lit(now).cast("timestamp"), newest_dt).alias("days_since_newest"),
                    "detail"))


def _tag_counts(tags: DataFrame, group: str, pick) -> DataFrame:
    return (tags.select(group, F.explode(pick(F.col("sts"))).alias("tag"))
            .groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n")))


def top_tags(tags: DataFrame, k: int = REPORTED_TAGS, group: str = "dt") -> DataFrame:
    """The k most frequent tags of each group, device tags left out."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "tag"))
    return _tag_counts(tags, group, plain_tags).withColumn("rank", rank).where(F.col("rank") <= k)


def dev_tag_counts(tags: DataFrame, group: str = "dt") -> DataFrame:
    """How often each device tag occurs in each group."""
    return _tag_counts(tags, group, device_tags)


def sum_values(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).alias("total"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def slow_ops(durations: DataFrame, limit_ms: float = SLOW_MS) -> DataFrame:
    return durations.where(F.col("ms") > limit_ms)


def ema_duration(durations: DataFrame, alpha: float = 0.5, parts: int | None = None) -> DataFrame:
    """Moving average per scope after its last measurement: (scope, ema, n).

    ``durations(scope, ts, id, ms)``; ``id`` makes the order total.
    """
    return moving_average(durations, ["scope"], ["ts", "id"], "ms", alpha, "ema", parts)


def max_duration(durations: DataFrame, parts: int | None = None) -> DataFrame:
    """Each measurement with the largest of its scope so far."""
    return running_max(durations, ["scope"], ["ts", "id"], "ms", "max_ms", parts)


def top_per_group(df: DataFrame, keys: list[str], k: int, by: list[Column]) -> DataFrame:
    """The first k rows of each group, numbered in ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
