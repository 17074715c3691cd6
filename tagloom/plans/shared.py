"""The shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# Folders made for single-machine sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a fresh local one only when unset.

    A cluster names a folder all executors reach, so tables written there survive the
    loss of any of them. The fallback exists for single-machine sessions alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app in _LOCAL:
        return _LOCAL[app]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    _LOCAL[app] = tempfile.mkdtemp(prefix="tagloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_dir(spark)}/tagloom/{label}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: the plan starts anew there."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Versions of a small table that are kept side by side.
SLOTS = 4


def store_version(df: DataFrame, path: str, version: int, schema: T.StructType) -> DataFrame:
    """Write a small table as a version of ``path``, in place of the one ``SLOTS`` before it.

    A repeated version replaces itself. Versions that readers may be at stay untouched.
    """
    slot = f"{path}/slot={version % SLOTS}"
    df.withColumn("_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(slot)
    return df.sparkSession.read.schema(schema).parquet(slot)


def latest_version(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame | None:
    """The newest version of ``path``, of those below ``before`` if that is given; None without any."""
    full = T.StructType([*schema.fields]).add("_version", "long").add("slot", "integer")
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        rows = rows.where(F.col("_version") < before)
    last = rows.agg(F.max("_version")).first()[0]
    return None if last is None else rows.where(F.col("_version") == last).select(*schema.fieldNames())
