"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import by_length
from ..operators import search, stats, tables
from . import views
from .reads import TAG_SQL, tags
from .registry import query
from .sqlviews import ts


@query("latest_222", f"SELECT {TAG_SQL} FROM tags_documents ORDER BY tid DESC LIMIT 222")
def latest_222(spark, folder):
    return tags(search.newest(views.tags_documents(spark, folder), search.LATEST_ROWS))


@query("latest_555", f"SELECT {TAG_SQL} FROM tags_events ORDER BY tid DESC LIMIT 555")
def latest_555(spark, folder):
    return tags(search.newest(views.tags_events(spark, folder), search.SEARCH_ROWS))


@query("tag_list", "SELECT ref FROM tags_events WHERE type IN ('signup', 'error')")
def tag_list(spark, folder):
    return search.tag_list(views.tags_events(spark, folder), ["signup", "error"])


@query("sort_by_column", f"SELECT {TAG_SQL} FROM tags_documents")
def sort_by_column(spark, folder):
    return tags(search.sort_by_column(views.tags_documents(spark, folder), "txt"))


@query("top_few", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_few(spark, folder):
    orders = views.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return search.top_few(orders, 10, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("top_few_per_group", """
    SELECT o_orderpriority, o_orderkey, o_totalprice,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders QUALIFY rank <= 3""")
def top_few_per_group(spark, folder):
    orders = views.table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return stats.top_per_group(orders, ["o_orderpriority"], 3, [F.desc("o_totalprice"), F.asc("o_orderkey")]
                               ).withColumn("rank", F.col("rank").cast("bigint"))


@query("tags_by_length", """
    SELECT tid, array_to_string(CASE WHEN length(sts[2]) > length(sts[1]) THEN [sts[2], sts[1]] ELSE sts END, '|') AS sts
    FROM tags_events""")
def tags_by_length(spark, folder):
    return views.tags_events(spark, folder).select("tid", by_length(F.col("sts")).alias("sts"))


@query("distinct_dt_desc", f"""
    SELECT {ts('dt')} AS dt FROM (SELECT DISTINCT dt FROM tags_events ORDER BY dt DESC LIMIT 11) x""")
def distinct_dt_desc(spark, folder):
    return stats.distinct_dt_desc(views.tags_events(spark, folder))


@query("union_rows", f"SELECT {TAG_SQL} FROM (SELECT * FROM server_snap UNION ALL SELECT * FROM local_snap) x")
def union_rows(spark, folder):
    return tags(tables.union_rows(views.server_snap(spark, folder), views.local_snap(spark, folder)))


@query("except_rows", """
    SELECT tid, txt, ref FROM server_snap s WHERE NOT EXISTS (
        SELECT 1 FROM local_snap l WHERE l.ref = s.ref AND l.txt = s.txt)""")
def except_rows(spark, folder):
    return tables.except_rows(
        views.server_snap(spark, folder), views.local_snap(spark, folder), ["ref", "txt"]).select("tid", "txt", "ref")


@query("intersect_keys", "SELECT tid, txt, ref FROM server_snap WHERE tid IN (SELECT tid FROM local_snap)")
def intersect_keys(spark, folder):
    return tables.intersect_keys(
        views.server_snap(spark, folder), views.local_snap(spark, folder), ["tid"]).select("tid", "txt", "ref")
