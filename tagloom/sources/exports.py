"""JSON out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TAGS


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def read_json(spark: SparkSession, path: str, schema=TAGS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def check_array(documents: DataFrame, column: str = "body") -> DataFrame:
    """Whether each text is a JSON array: its length in ``items``, else an error object."""
    size = F.json_array_length(F.col(column))
    return documents.withColumn("items", size).withColumn(
        "error", F.when(size.isNull(), F.lit('{"error":"not an array"}')))
