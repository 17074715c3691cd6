"""Whole-table snapshots and keyed backups.

A snapshot is a folder of Parquet files and one row of the manifest. The manifest row
is appended after the data is complete, so a reader never sees half a snapshot.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.dates import fmt_ym
from ..schema import MANIFEST, TAGS

# Size that marks a snapshot as too large, name that snapshots start with.
OVERSIZE_BYTES = 50 * 1024 * 1025
PREFIX = "tags"


def content_hash(df: DataFrame) -> DataFrame:
    """(row_count, content_hash) of a table, whatever its row order."""
    return df.agg(*_content(df))


def _content(df: DataFrame) -> list[Column]:
    # Hashed as JSON, so that null, empty and shifted values stay apart.
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return [
        F.count(F.lit(1)).alias("row_count"),
        # Summed as decimals: 64-bit sums overflow, and equal rows would cancel in an xor.
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("content_hash")]


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a folder, from the file system's own records."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows; an empty table while there is no snapshot."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def latest_snapshot(manifest: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """One row (outcome, name, path): ok, or none, or no match for the prefix."""
    named = F.startswith("name", F.lit(prefix))
    newest = F.struct("created_at", "name", "path")
    return manifest.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(named, newest)).alias("s"),
    ).select(
        F.when(F.col("n") == 0, "none").when(F.col("s").isNull(), "no match").otherwise("ok")
        .alias("outcome"), "s.name", "s.path")


def is_unchanged(df: DataFrame, manifest: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """One row (row_count, content_hash, unchanged): the same rows as the newest snapshot?"""
    last = (manifest.where(F.startswith("name", F.lit(prefix)))
            .agg(F.max_by(F.struct("row_count", "content_hash"), "created_at").alias("s")))
    same = ((F.col("row_count") == last.select("s.row_count").scalar())
            & (F.col("content_hash") == last.select("s.content_hash").scalar()))
    return content_hash(df).withColumn("unchanged", F.coalesce(same, F.lit(False)))


def write_snapshot(df: DataFrame, root: str, now: datetime, prefix: str = PREFIX,
                   skip_unchanged: bool = False) -> DataFrame:
    """Write a snapshot and return its manifest row; with ``skip_unchanged`` maybe none.

    The name tells the month and the number of rows, as ``tags2024-01.1000``. A size
    over the limit is reported in ``oversize``; Parquet has no such limit of its own.
    """
    spark = df.sparkSession
    if skip_unchanged and is_unchanged(df, read_manifest(spark, root), prefix).first()["unchanged"]:
        return spark.createDataFrame([], MANIFEST)
    stamp: Column = F.lit(now).cast("timestamp")
    label = spark.range(1).select(
        fmt_ym(stamp).alias("month"), F.date_format(stamp, "yyyyMMddHHmmssSSS").alias("time")).first()
    path = f"{root}/data/{prefix}.{label['time']}"
    # Counted and hashed in the tasks that write, so that the rows pass by once.
    facts = Observation()
    seen = df.observe(facts, *_content(df))
    seen.write.mode("overwrite").option("compression", "zstd").parquet(path)
    facts, size = facts.get, folder_size(spark, path)
    row = spark.createDataFrame([(
        f"{prefix}{label['month']}.{facts['row_count']}", path, facts["row_count"], size,
        facts["content_hash"], size > OVERSIZE_BYTES, now)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return row


def read_snapshot(spark: SparkSession, root: str, prefix: str = PREFIX, schema=TAGS) -> DataFrame:
    """The newest snapshot's rows."""
    found = latest_snapshot(read_manifest(spark, root), prefix).first()
    if found["outcome"] != "ok":
        raise FileNotFoundError(f"snapshot: {found['outcome']}")
    return spark.read.schema(schema).parquet(found["path"])


def backup_rows(df: DataFrame, root: str, key: str, now) -> None:
    """Append the rows under a backup key and time."""
    (df.withColumn("backup_key", F.lit(key)).withColumn("backup_at", F.lit(now).cast("timestamp"))
     .write.mode("append").partitionBy("backup_key").parquet(f"{root}/backups"))


def read_backups(spark: SparkSession, root: str, schema: T.StructType = TAGS) -> DataFrame:
    full = T.StructType(list(schema.fields)).add("backup_at", "timestamp").add("backup_key", "string")
    return spark.read.schema(full).parquet(f"{root}/backups")
