"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import device_tags, plain_tags, row_equal
from ..operators import search, stats, tables
from ..sources import remote
from . import views
from .reads import TAG_SQL, tags
from .registry import query
from .sqlviews import joined, ts


@query("project_grid", f'SELECT txt, {joined("sts")} AS sts, ref, tid AS "locTid" FROM tags_documents')
def project_grid(spark, folder):
    return search.project_grid(views.tags_documents(spark, folder))


@query("map_remote_to_tag", f"""
    SELECT {TAG_SQL}, 'e' || tid AS entry_id, CAST(tid AS VARCHAR) AS ats FROM tags_documents""")
def map_remote_to_tag(spark, folder):
    return remote.map_remote_to_tag(views.remote_rt(spark, folder)).drop("modAt", "rec")


@query("drop_pk", f"""
    SELECT CAST(NULL AS BIGINT) AS tid, txt, ref, {joined('sts')} AS sts, {ts('dt')} AS dt, type FROM tags_documents""")
def drop_pk(spark, folder):
    return tags(search.drop_pk(views.tags_documents(spark, folder)))


@query("type_in", f"SELECT {TAG_SQL} FROM tags_events WHERE type IN ('signup', 'purchase')")
def type_in(spark, folder):
    return tags(search.type_in(views.tags_events(spark, folder), ["signup", "purchase"]))


@query("filter_all_tags", f"""
    SELECT {TAG_SQL} FROM tags_documents WHERE list_contains(sts, 'en') AND list_contains(sts, 'src1')""")
def filter_all_tags(spark, folder):
    return tags(search.filter_all_tags(views.tags_documents(spark, folder), ["en", "src1"]))


@query("search_terms", """
    SELECT 'two words' AS query, tid, txt FROM tags_documents
    WHERE contains(lower(txt), 'the') AND contains(lower(txt), 'whou')
    UNION ALL SELECT 'phrase', tid, txt FROM tags_documents
    WHERE contains(lower(txt), 'of the') AND contains(lower(txt), 'and')
    UNION ALL SELECT 'none', tid, txt FROM tags_documents WHERE contains(lower(txt), 'zzzz')""")
def search_terms(spark, folder):
    wanted = {"two words": "The whou", "phrase": '"OF the" and', "none": "zzzz"}
    return search.search_many(views.tags_documents(spark, folder), wanted).select("query", "tid", "txt")


@query("search_and_tags", f"""
    SELECT txt, {joined('sts')} AS sts, ref, tid AS "locTid" FROM tags_documents
    WHERE list_contains(sts, 'en') AND contains(lower(txt), 'the') AND contains(lower(txt), 'whou')
    ORDER BY tid DESC LIMIT 555""")
def search_and_tags(spark, folder):
    return search.project_grid(search.search_and_tags(
        views.tags_documents(spark, folder), "the whou", ["en"]))


@query("dirty_rows", "SELECT tid, txt, ref FROM local_sync WHERE dirty")
def dirty_rows(spark, folder):
    return search.dirty_rows(views.local_sync(spark, folder)).select("tid", "txt", "ref")


@query("fill_missing_dt", f"""
    SELECT tid, {ts("coalesce(dt, TIMESTAMP '2024-05-01 12:00:00')")} AS dt, dt IS NULL AS fixed,
           count(*) FILTER (WHERE dt IS NULL) OVER () AS n_fixed FROM local_sync""")
def fill_missing_dt(spark, folder):
    filled = tables.fill_missing_dt(views.local_sync(spark, folder), views.NOW)
    fixed = filled.select(F.count_if("fixed")).scalar()
    return filled.select("tid", "dt", "fixed", fixed.alias("n_fixed"))


@query("get_by_ref_type", f"""
    SELECT {TAG_SQL} FROM tags_dups WHERE ref = 'src1' AND type = 'en' ORDER BY tid LIMIT 1""")
def get_by_ref_type(spark, folder):
    return tags(search.get_by_ref_type(views.tags_dups(spark, folder), "src1", "en"))


@query("pk_below_above", """
    (SELECT 'below' AS side, tid, txt FROM tags_documents WHERE tid < 100 ORDER BY tid DESC LIMIT 16)
    UNION ALL (SELECT 'above', tid, txt FROM tags_documents WHERE tid > 100 ORDER BY tid LIMIT 16)""")
def pk_below_above(spark, folder):
    docs = views.tags_documents(spark, folder)
    sides = {"below": search.pk_below(docs, 100, 16), "above": search.pk_above(docs, 100, 16)}
    return tables.union_rows(*[
        df.select(F.lit(side).alias("side"), "tid", "txt") for side, df in sides.items()])


@query("eq_dt", f"SELECT {TAG_SQL} FROM tags_documents WHERE dt = TIMESTAMP '2024-01-10'")
def eq_dt(spark, folder):
    return tags(search.eq_dt(views.tags_documents(spark, folder), "2024-01-10 00:00:00"))


@query("split_dev_tags", """
    SELECT tid, array_to_string(list_filter(sts, lambda t: NOT starts_with(t, 'dev_')), '|') AS plain,
           array_to_string(list_transform(list_filter(sts, lambda t: starts_with(t, 'dev_')),
                                          lambda t: t[5:]), '|') AS devices
    FROM tags_events""")
def split_dev_tags(spark, folder):
    return views.tags_events(spark, folder).select(
        "tid", plain_tags(F.col("sts")).alias("plain"), device_tags(F.col("sts")).alias("devices"))


@query("slow_ops", "SELECT scope, id, ms FROM durations WHERE ms > 33.3")
def slow_ops(spark, folder):
    return stats.slow_ops(views.durations(spark, folder), 33.3).select("scope", "id", "ms")


@query("row_equal", """
    SELECT s.tid, s.ref IS NOT DISTINCT FROM l.ref AND s.txt IS NOT DISTINCT FROM l.txt
           AND s.type IS NOT DISTINCT FROM l.type AS same
    FROM server_snap s JOIN local_snap l ON l.tid = s.tid""")
def row_equal_(spark, folder):
    server, local = views.server_snap(spark, folder), views.local_snap(spark, folder)
    return server.alias("s").join(local.alias("l"), F.col("s.tid") == F.col("l.tid")).select(
        F.col("s.tid").alias("tid"), row_equal("s", "l").alias("same"))
