"""Scans, sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import feed_first_post
from ..operators import links, tables
from ..plans.shared import fresh_path
from ..schema import TAG_COLUMNS, TAGS
from ..sources import exports, remote, snapshots
from . import views
from .registry import query
from .sqlviews import joined, ts
from .views import at

TAG_SQL = f"tid, txt, ref, {joined('sts')} AS sts, {ts('dt')} AS dt, type"
SNAP_TIME = datetime(2024, 5, 1, 12, 0, 0)


def tags(df):
    return df.select("tid", "txt", "ref", "sts", "dt", "type")


@query("scan_tags", f"SELECT {TAG_SQL} FROM tags_documents")
def scan_tags(spark, folder):
    path = fresh_path(spark, "tags")
    views.tags_documents(spark, folder).write.parquet(path)
    return tags(remote.scan_tags(spark, path))


@query("scan_rt_latest", f"SELECT {TAG_SQL} FROM tags_documents")
def scan_rt_latest(spark, folder):
    return tags(remote.scan_rt_latest(views.remote_rt(spark, folder)))


def _label_rows(spark, folder):
    """New rows at a third of the labelled ids, three times: some keys exist, and most come more than once."""
    return views.table(spark, folder, "labels").select(
        (F.floor(F.col("doc_id") / 3) * 3).alias("tid"),
        F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("txt"),
        F.concat(F.lit("label/"), F.col("doc_id").cast("string")).alias("ref"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).alias("sts"),
        at(views.NOW).alias("dt"), F.lit("label").alias("type"),
        F.lit(None).cast("timestamp").alias("modAt"), F.lit(None).cast("string").alias("rec"))


@query("upsert_tags", f"""
    WITH fresh AS (SELECT doc_id // 3 * 3 AS tid, 'label ' || doc_id AS txt, 'label/' || doc_id AS ref,
            CASE WHEN toxic = 1 THEN ['toxic'] END AS sts, TIMESTAMP '2024-05-01 12:00:00' AS dt,
            'label' AS type FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY 'label/' || doc_id DESC) = 1),
         merged AS (SELECT tid, txt, ref, sts, dt, type FROM tags_documents
                    WHERE tid NOT IN (SELECT tid FROM fresh) UNION ALL SELECT * FROM fresh)
    SELECT {TAG_SQL} FROM merged""")
def upsert_tags(spark, folder):
    return tags(tables.upsert(views.tags_documents(spark, folder), _label_rows(spark, folder), order=["ref"]))


@query("bulk_update", f"""
    SELECT t.tid, t.txt, t.ref, {joined('t.sts')} AS sts, {ts('t.dt')} AS dt,
           CASE WHEN l.toxic = 1 THEN 'toxic' ELSE t.type END AS type
    FROM tags_documents t LEFT JOIN labels l ON l.doc_id = t.tid""")
def bulk_update(spark, folder):
    changes = views.table(spark, folder, "labels").select(
        F.col("doc_id").alias("tid"), F.when(F.col("toxic") == 1, "toxic").alias("type"))
    return tags(tables.bulk_update(views.tags_documents(spark, folder), changes))


@query("delete_by_key", f"""
    SELECT {TAG_SQL} FROM tags_documents
    WHERE tid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_by_key(spark, folder):
    gone = views.table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("tid"))
    return tags(tables.delete_by_key(views.tags_documents(spark, folder), gone))


@query("push_rows", f"""
    SELECT ref, type, strftime(dt, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS dt, txt, {joined('sts')} AS sts,
           CAST(NULL AS VARCHAR) AS ats, nullif(tid, 0) AS tid, 'user-1' AS user_id FROM tags_documents""")
def push_rows(spark, folder):
    return remote.push_rows(views.tags_documents(spark, folder), "user-1")


@query("write_snapshot", """
    SELECT 'tags2024-05.' || count(*) AS name, count(*) AS row_count, FALSE AS oversize FROM documents""")
def write_snapshot(spark, folder):
    return snapshots.write_snapshot(
        views.tags_documents(spark, folder), fresh_path(spark, "snap"), SNAP_TIME,
    ).select("name", "row_count", "oversize")


@query("snapshot_skip_unchanged", """
    SELECT 'same' AS variant, count(*) AS row_count, TRUE AS unchanged FROM documents
    UNION ALL SELECT 'edited', count(*), FALSE FROM documents
    UNION ALL SELECT 'emptied tags', count(*), FALSE FROM documents""")
def snapshot_skip_unchanged(spark, folder):
    root, docs = fresh_path(spark, "snap"), views.tags_documents(spark, folder)
    snapshots.write_snapshot(docs, root, SNAP_TIME)
    manifest = snapshots.read_manifest(spark, root)
    variants = {
        "same": docs.orderBy(F.desc("txt")),
        "edited": views.local_snap(spark, folder),
        "emptied tags": docs.withColumn("sts", F.when(F.col("tid") > 0, F.col("sts"))),
    }
    return tables.union_rows(*[
        snapshots.is_unchanged(df, manifest).select(F.lit(name).alias("variant"), "row_count", "unchanged")
        for name, df in variants.items()])


@query("latest_snapshot", """
    SELECT 'tags' AS prefix, 'ok' AS outcome, 'tags2024-05.' || count(*) AS name FROM documents
    UNION ALL SELECT 'misc', 'no match', NULL""")
def latest_snapshot(spark, folder):
    root, docs = fresh_path(spark, "snap"), views.tags_documents(spark, folder)
    snapshots.write_snapshot(views.tags_events(spark, folder), root, datetime(2024, 4, 1))
    snapshots.write_snapshot(docs, root, SNAP_TIME)
    manifest = snapshots.read_manifest(spark, root)
    return tables.union_rows(*[
        snapshots.latest_snapshot(manifest, prefix).select(F.lit(prefix).alias("prefix"), "outcome", "name")
        for prefix in ("tags", "misc")])


@query("read_snapshot", f"SELECT {TAG_SQL} FROM tags_documents")
def read_snapshot(spark, folder):
    root = fresh_path(spark, "snap")
    snapshots.write_snapshot(views.tags_dups(spark, folder), root, datetime(2024, 4, 1))
    snapshots.write_snapshot(views.tags_documents(spark, folder), root, SNAP_TIME)
    return tags(snapshots.read_snapshot(spark, root))


@query("backup_rows", """
    SELECT 'before download' AS backup_key, count(*) AS n, sum(tid) AS tids FROM local_snap""")
def backup_rows(spark, folder):
    root = fresh_path(spark, "backup")
    snapshots.backup_rows(views.local_snap(spark, folder), root, "before download", views.NOW)
    return snapshots.read_backups(spark, root).groupBy("backup_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tid").alias("tids"))


@query("export_json", f"SELECT {TAG_SQL} FROM tags_documents")
def export_json(spark, folder):
    path = fresh_path(spark, "json")
    exports.export_json(views.tags_documents(spark, folder), path)
    return tags(exports.read_json(spark, path, TAGS).select(*TAG_COLUMNS))


@query("ingest_md_links", r"""
    WITH titled AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, url AS ref FROM pages),
    cut AS (SELECT *, greatest(-1, CASE WHEN contains(t, '-') THEN length(t) - strpos(reverse(t), '-') ELSE -1 END,
                   CASE WHEN contains(t, '|') THEN length(t) - strpos(reverse(t), '|') ELSE -1 END,
                   CASE WHEN contains(t, ' - ') THEN length(t) - strpos(reverse(t), ' - ') - 2 ELSE -1 END,
                   CASE WHEN contains(t, ' | ') THEN length(t) - strpos(reverse(t), ' | ') - 2 ELSE -1 END) AS cutoff
            FROM titled),
    stem AS (SELECT *, cutoff > greatest(1, length(t) - 33) AS has,
                    CASE WHEN cutoff > greatest(1, length(t) - 33) THEN trim(t[:cutoff]) ELSE t END AS s FROM cut),
    ended AS (SELECT *, strpos(s[34:], '. ') AS a, strpos(s[34:], '; ') AS b FROM stem)
    SELECT page_id, 'tab' AS type, ref,
           trim(CASE WHEN a > 0 AND (b = 0 OR a < b) THEN s[:32 + a] WHEN b > 0 THEN s[:32 + b] ELSE s END) AS txt,
           'markdown_pasted' || CASE WHEN has THEN '|suffix_' || regexp_replace(t[cutoff + 1:], '[^\p{L}\p{N}_]', '', 'g') ELSE '' END AS sts,
           '2024-05-01 12:00:00.000000' AS dt
    FROM ended""")
def ingest_md_links(spark, folder):
    return links.ingest_md_links(views.md_links(spark, folder), "text", views.NOW).select(
        "page_id", "type", "ref", "txt", "sts", "dt")


@query("extract_links", r"""
    WITH found AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
    each_one AS (SELECT page_id, unnest(hrefs) AS link, unnest(generate_series(1, len(hrefs))) AS i FROM found),
    once AS (SELECT page_id, link, min(i) AS i FROM each_one GROUP BY page_id, link)
    SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM once""")
def extract_links(spark, folder):
    return links.page_links(views.table(spark, folder, "pages"), keep=["page_id"]).withColumn(
        "place", F.col("place").cast("bigint"))


@query("extract_links_absolute", r"""
    WITH found AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
                          regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
    each_one AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(generate_series(1, len(hrefs))) AS i FROM found),
    once AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS link, min(i) AS i
             FROM each_one GROUP BY 1, 2)
    SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM once""")
def extract_links_absolute(spark, folder):
    return links.page_links(views.table(spark, folder, "pages"), keep=["page_id"], url="url").withColumn(
        "place", F.col("place").cast("bigint"))


@query("feed_first_post", r"""
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '(no post found)'
           ELSE regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') END AS post
    FROM pages""")
def feed_first_post_(spark, folder):
    card = F.struct(F.lit(11).alias("card_type"), F.struct(F.lit("<b>other</b>").alias("text")).alias("mblog"))
    post = F.struct(F.when(F.col("page_id") % 4 == 0, 7).otherwise(9).alias("card_type"),
                    F.struct(F.col("html").alias("text")).alias("mblog"))
    feed = F.to_json(F.struct(F.struct(F.array(card, post).alias("cards")).alias("data")))
    return views.table(spark, folder, "pages").select("page_id", feed_first_post(feed).alias("post"))
