"""Tag and phrase search, lookups, sorting and limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tags import has_all_tags

# How many rows the lists show.
LATEST_ROWS = 222
SEARCH_ROWS = 555


def search_words(query: str) -> list[str]:
    """Lower-case terms of a query; quoted phrases stay whole."""
    found = re.findall(r'"[^"]*"|\S+', query)
    return [re.sub(r'^"|"$', "", term).strip().lower() for term in found]


def text_matches(text: Column, query: str) -> Column:
    """Every term occurs in the text, whatever the case."""
    keep = F.lit(True)
    for term in search_words(query):
        keep = keep & F.contains(F.lower(text), F.lit(term))
    return keep


def project_grid(tags: DataFrame) -> DataFrame:
    return tags.select("txt", "sts", "ref", F.col("tid").alias("locTid"))


def drop_pk(tags: DataFrame) -> DataFrame:
    return tags.withColumn("tid", F.lit(None).cast("bigint"))


def type_in(tags: DataFrame, types: list[str]) -> DataFrame:
    return tags.where(F.col("type").isin(types))


def filter_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    return tags.where(has_all_tags(F.col("sts"), wanted))


def search_terms(tags: DataFrame, query: str, match_tags: bool = False) -> DataFrame:
    """Rows whose text has every term; with ``match_tags`` also rows tagged with the query."""
    keep = text_matches(F.col("txt"), query)
    if match_tags:
        keep = keep | has_all_tags(F.col("sts"), [query])
    return tags.where(keep)


def search_many(tags: DataFrame, queries: dict[str, str]) -> DataFrame:
    """One row per (query, matching row), from a single scan.

    The queries are few and come from the caller, so they are part of the expression
    and no join is needed.
    """
    hits = F.array(*[
        F.when(text_matches(F.col("txt"), q), F.lit(name)) for name, q in queries.items()])
    return tags.withColumn("query", F.explode(F.filter(hits, lambda h: h.isNotNull())))


def newest(tags: DataFrame, n: int) -> DataFrame:
    """The n rows with the largest keys."""
    return tags.orderBy(F.desc_nulls_last("tid")).limit(n)


def search_and_tags(tags: DataFrame, query: str = "", wanted: list[str] | None = None,
                    n: int = SEARCH_ROWS) -> DataFrame:
    """Newest rows that carry all tags and whose text has all terms."""
    hits = filter_all_tags(tags, wanted or [])
    return newest(search_terms(hits, query) if query else hits, n)


def dirty_rows(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("modAt").isNotNull())


def get_by_ref_type(tags: DataFrame, ref: str, type_: str) -> DataFrame:
    """One row with this ref and type, the smallest key when there are several."""
    return tags.where((F.col("ref") == ref) & (F.col("type") == type_)).orderBy("tid").limit(1)


def pk_below(tags: DataFrame, tid: int, n: int) -> DataFrame:
    """The n nearest rows below a key."""
    return tags.where(F.col("tid") < tid).orderBy(F.desc("tid")).limit(n)


def pk_above(tags: DataFrame, tid: int, n: int) -> DataFrame:
    """The n nearest rows above a key."""
    return tags.where(F.col("tid") > tid).orderBy("tid").limit(n)


def eq_dt(tags: DataFrame, dt) -> DataFrame:
    """Rows at one update time."""
    return tags.where(F.col("dt") == F.lit(dt).cast("timestamp"))


def tag_list(tags: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Names of tag rows, oldest first."""
    return type_in(tags, types or ["topTag", "tag"]).orderBy("dt", "tid").select("ref")


def sort_by_column(tags: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort on one column, nulls last, ties by key."""
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return tags.orderBy(key, "tid")


def top_few(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first k rows in the given order, in that order."""
    return df.orderBy(*by).limit(k)


def tree_overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults overlaid with stored values; keys without a default are left out."""
    return (defaults.alias("d").join(stored.alias("s"), "key", "left")
            .select("key", F.coalesce("s.value", "d.value").alias("value")))
