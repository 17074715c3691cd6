"""Where queries register, and how their results are made comparable."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure
from .sqlviews import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that computes the same from the same tables."""
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return flat(fn(configure(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return run

    return register


def flat(df: DataFrame) -> DataFrame:
    """Times as text, lists as text joined by bars: the same in every engine."""
    def shown(field):
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "array":
            column = F.array_join(column, "|")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
