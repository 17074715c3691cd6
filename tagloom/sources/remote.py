"""The remote table: read it newest first, map its rows to tags and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import upsert
from ..schema import REMOTE, TAG_COLUMNS, TAGS, as_tags


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Any Spark source by its format name; files are read with a stated schema.

    JDBC takes its options (url, dbtable, partitionColumn, ...) and no path.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load() if fmt == "jdbc" else reader.load(path)


def scan_tags(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema=TAGS)


def scan_remote(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, fmt, REMOTE, **options)


def map_remote_to_tag(remote: DataFrame) -> DataFrame:
    """Remote rows as tags. The time is text on the wire; identity beyond ``tid`` is kept."""
    timed = remote.withColumn("dt", F.to_timestamp("dt"))
    extra = [c for c in ("entry_id", "ats") if c in remote.columns]
    return as_tags(timed, extra)


def scan_rt_latest(remote: DataFrame) -> DataFrame:
    """All remote rows as tags, the newest first."""
    return map_remote_to_tag(remote).orderBy(F.desc_nulls_last("dt"), F.desc_nulls_last("tid"))


def load_remote(tags: DataFrame, remote: DataFrame) -> DataFrame:
    """The local table after the initial load: remote rows upserted by key."""
    return upsert(tags, map_remote_to_tag(remote).select(*TAG_COLUMNS))


def push_rows(tags: DataFrame, user_id: str) -> DataFrame:
    """Local rows in the remote schema: time as text, missing values null, the user's id."""
    return tags.select(
        "ref", "type",
        F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("dt"),
        "txt", "sts",
        (F.col("ats") if "ats" in tags.columns else F.lit(None)).cast("array<bigint>").alias("ats"),
        F.nullif(F.col("tid"), F.lit(0)).alias("tid"), F.lit(user_id).alias("user_id"))
