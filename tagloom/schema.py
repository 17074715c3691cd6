"""Table schemas. They are always passed to readers; nothing is inferred from data."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

TAGS = T.StructType([
    T.StructField("tid", T.LongType()),
    T.StructField("txt", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("sts", T.ArrayType(T.StringType())),
    T.StructField("dt", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("modAt", T.TimestampType()),
    T.StructField("rec", T.StringType()),
])
TAG_COLUMNS = TAGS.fieldNames()

REMOTE = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("tid", T.LongType()),
    T.StructField("txt", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sts", T.ArrayType(T.StringType())),
    T.StructField("ats", T.ArrayType(T.LongType())),
    T.StructField("dt", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("tid", T.LongType()),
    T.StructField("mdl", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])

STATS = T.StructType([
    T.StructField("tid", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

CONFIG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("entry_id", T.StringType()),
    *TAGS.fields,
])

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("content_hash", T.DecimalType(38, 0)),
    T.StructField("oversize", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])


def as_tags(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Order and cast to the tag schema; columns the input lacks become null."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TAGS.fields
    ] + list(extra or []))


def tag_struct(prefix: str | None = None) -> Column:
    """All tag columns of one join side as a struct."""
    at = f"{prefix}." if prefix else ""
    return F.struct([F.col(at + c).alias(c) for c in TAG_COLUMNS])
