"""Joins: comparison, classification, overlays and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, search, similarity, sync, tables
from . import views
from .reads import tags
from .registry import query
from .sqlviews import joined, ts

SAME = ("l.ref IS NOT DISTINCT FROM s.ref AND l.txt IS NOT DISTINCT FROM s.txt "
        "AND l.type IS NOT DISTINCT FROM s.type AND l.sts IS NOT DISTINCT FROM s.sts")
STATUS = f"""CASE WHEN EXISTS (SELECT 1 FROM local_snap l WHERE {SAME}) THEN 'matched'
                  WHEN EXISTS (SELECT 1 FROM local_snap l WHERE l.tid = s.tid) THEN 'clash' ELSE 'new' END"""
LAST_DT = "2024-01-16 00:00:00"
# Categories of every key, as the sync rules state them.
CLASSES = """
    SELECT coalesce(b.type, m.type) AS type, coalesce(b.ref, m.ref) AS ref,
           CASE WHEN b.ref IS NULL THEN
                  CASE WHEN (SELECT max(dt) FROM base) = {last} THEN 'ins' ELSE 'blocked' END
                WHEN m.ref IS NOT NULL THEN
                  CASE WHEN m.dt IS NOT DISTINCT FROM b.dt THEN 'upd' ELSE 'toMerge' END
                WHEN {last} IS NULL OR b.dt > {last} THEN 'newer' ELSE 'unchanged' END AS category,
           m.tid AS mod_tid, b.tid AS base_tid
    FROM base b FULL JOIN (SELECT * FROM local_sync WHERE dirty) m ON b.type = m.type AND b.ref = m.ref"""


@query("diff_new", f"""
    SELECT s.tid, s.txt, s.ref, {joined('s.sts')} AS sts, {ts('s.dt')} AS dt, s.type FROM server_snap s
    WHERE NOT EXISTS (SELECT 1 FROM local_snap l WHERE {SAME})""")
def diff_new(spark, folder):
    return tags(diff.diff_new(views.local_snap(spark, folder), views.server_snap(spark, folder)))


@query("diff_clash", f"""
    SELECT s.tid, s.txt, s.ref, {joined('s.sts')} AS sts, {ts('s.dt')} AS dt, s.type FROM server_snap s
    WHERE NOT EXISTS (SELECT 1 FROM local_snap l WHERE {SAME})
      AND EXISTS (SELECT 1 FROM local_snap l WHERE l.tid = s.tid)""")
def diff_clash(spark, folder):
    return tags(diff.diff_clash(views.local_snap(spark, folder), views.server_snap(spark, folder)))


@query("diff_tags", f"SELECT s.tid, s.ref, s.txt, {STATUS} AS status FROM server_snap s")
def diff_tags(spark, folder):
    return diff.diff_tags(views.local_snap(spark, folder), views.server_snap(spark, folder)).select(
        "tid", "ref", "txt", "status")


@query("diff_summary", f"""
    WITH d AS (SELECT {STATUS} AS status FROM server_snap s)
    SELECT count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'clash') AS clash,
           count(*) FILTER (WHERE status = 'matched') AS matched, count(*) AS total,
           round(100.0 * count(*) FILTER (WHERE status = 'matched') / count(*), 1) AS matched_pct FROM d""")
def diff_summary(spark, folder):
    return diff.diff_summary(diff.diff_tags(
        views.local_snap(spark, folder), views.server_snap(spark, folder)))


@query("occ_classify", " UNION ALL ".join(
    f"SELECT '{name}' AS last_dt, c.* FROM ({CLASSES.format(last=value)}) c" for name, value in
    [("behind", f"TIMESTAMP '{LAST_DT}'"), ("up to date", "(SELECT max(dt) FROM base)"),
     ("none", "CAST(NULL AS TIMESTAMP)")]))
def occ_classify(spark, folder):
    base, local = views.base(spark, folder), views.local_sync(spark, folder)
    marks = {"behind": LAST_DT, "up to date": base.select(F.max("dt")).scalar(), "none": None}
    return tables.union_rows(*[
        sync.occ_classify(base, search.dirty_rows(local), mark).select(
            F.lit(name).alias("last_dt"), "type", "ref", "category",
            F.col("mod.tid").alias("mod_tid"), F.col("base.tid").alias("base_tid"))
        for name, mark in marks.items()])


@query("ack_clean", f"""
    SELECT tid, txt, ref, {ts("CASE WHEN ok THEN TIMESTAMP '2024-05-01 12:00:00' ELSE dt END")} AS dt,
           dirty AND NOT ok AS dirty
    FROM (SELECT l.*, dirty AND EXISTS (SELECT 1 FROM base b WHERE b.type = l.type AND b.ref = l.ref
          AND b.dt = l.dt) AS ok FROM local_sync l) x""")
def ack_clean(spark, folder):
    base, local = views.base(spark, folder), views.local_sync(spark, folder)
    accepted = sync.occ_classify(base, search.dirty_rows(local), LAST_DT).where(
        F.col("category").isin(*sync.ACCEPTED))
    return sync.ack_clean(local, accepted, views.NOW).select(
        "tid", "txt", "ref", "dt", F.col("modAt").isNotNull().alias("dirty"))


# Incoming rows (sent back at LAST_DT), the dirty row of the same key, the row on the same tid.
RECONCILE = f"""
    cls AS ({CLASSES.format(last=f"TIMESTAMP '{LAST_DT}'")}),
    inc AS (SELECT b.* FROM base b JOIN cls c ON c.type = b.type AND c.ref = b.ref
            WHERE c.category IN ('toMerge', 'newer')),
    paired AS (SELECT b.*, m.ref IS NOT NULL AS has_mine, m.txt AS m_txt, m.sts AS m_sts,
                      m.has_origin AND m.origin_dt = b.prev_dt AS patch, m.origin_txt,
                      h.ref IS NOT NULL AND NOT (h.ref = b.ref AND h.type = b.type) AS moves,
                      h.txt AS h_txt, h.ref AS h_ref, h.sts AS h_sts, h.dt AS h_dt, h.type AS h_type
               FROM inc b LEFT JOIN (SELECT * FROM local_sync WHERE dirty) m ON m.type = b.type AND m.ref = b.ref
               LEFT JOIN local_sync h ON h.tid = b.tid),
    puts AS (SELECT CASE WHEN has_mine THEN 'merged' ELSE 'server' END AS action, tid,
                    CASE WHEN patch THEN 'server ' || origin_txt || ' local'
                         WHEN has_mine THEN m_txt ELSE txt END AS txt,
                    ref, CASE WHEN has_mine THEN m_sts ELSE sts END AS sts, dt, type, has_mine AS dirty,
                    CASE WHEN patch OR NOT has_mine THEN 'server' END AS note,
                    coalesce(patch, FALSE) AS has_b4mod FROM paired
             UNION ALL SELECT 'moved', NULL, h_txt, h_ref, h_sts, h_dt, h_type, TRUE, NULL, FALSE
             FROM paired WHERE moves)"""


def _shown(puts):
    return puts.select(
        "action", "tid", "txt", "ref", "sts", "dt", "type", F.col("modAt").isNotNull().alias("dirty"),
        F.get_json_object("rec", "$.note").alias("note"),
        F.get_json_object("rec", "$.b4mod").isNotNull().alias("has_b4mod"))


@query("sync_reconcile", f"""
    WITH {RECONCILE}
    SELECT action, tid, txt, ref, {joined('sts')} AS sts, {ts('dt')} AS dt, type, dirty, note, has_b4mod FROM puts""")
def sync_reconcile(spark, folder):
    base, local = views.base(spark, folder), views.local_sync(spark, folder)
    incoming = sync.occ_classify(base, search.dirty_rows(local), LAST_DT).where(
        F.col("category").isin(*sync.SENT_BACK)).select("base.*")
    return _shown(sync.sync_reconcile(local, incoming, views.NOW))


@query("bulk_merge", f"""
    WITH met AS (SELECT b.*, l.txt AS l_txt, l.ref AS l_ref, l.type AS l_type, l.sts AS l_sts, l.dt AS l_dt,
                        b.ref = l.ref AND b.type = l.type AS same
                 FROM base b JOIN local_sync l ON l.tid = b.tid),
    out AS (SELECT CASE WHEN same THEN 'merged' ELSE 'placed' END AS action, tid, txt, ref, sts,
                   CASE WHEN same THEN l_dt ELSE dt END AS dt, type FROM met
            UNION ALL SELECT 'displaced', NULL, l_txt, l_ref, l_sts, l_dt, l_type FROM met WHERE NOT same)
    SELECT action, tid, txt, ref, {joined('sts')} AS sts, {ts('dt')} AS dt, type, TRUE AS dirty FROM out""")
def bulk_merge(spark, folder):
    return sync.bulk_merge(views.local_sync(spark, folder), views.base(spark, folder), views.NOW).select(
        "action", "tid", "txt", "ref", "sts", "dt", "type", F.col("modAt").isNotNull().alias("dirty"))


@query("insert_if_absent", """
    WITH known AS (SELECT DISTINCT lang AS ref FROM documents),
         cand AS (SELECT DISTINCT unnest([lang, source]) AS name FROM documents)
    SELECT name AS ref, 'tag' AS type, name || ': ' AS txt, name AS sts FROM cand
    WHERE name NOT IN (SELECT ref FROM known)""")
def insert_if_absent(spark, folder):
    docs = views.table(spark, folder, "documents")
    known = tables.tag_rows(docs.select(F.col("lang").alias("name")).distinct(), views.NOW)
    stored = tables.union_rows(views.tags_documents(spark, folder), known)
    names = docs.select(F.explode(F.array("lang", "source")).alias("name")).distinct()
    return tables.insert_if_absent(stored, tables.tag_rows(names, views.NOW)).select(
        "ref", "type", "txt", "sts")


@query("last_per_prefix", """
    SELECT user_id, event_id, event_type FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def last_per_prefix(spark, folder):
    events = views.table(spark, folder, "events")
    return tables.last_per_prefix(
        events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"],
        events.where("event_type = 'error'")).select("user_id", "event_id", "event_type")


@query("config_overlay", """
    WITH d AS (SELECT event_type AS key, 'default ' || event_type AS value FROM events GROUP BY 1),
         s AS (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events
               WHERE event_type < 'q' GROUP BY 1
               UNION ALL SELECT lang, 'unknown key' FROM documents GROUP BY 1)
    SELECT d.key, coalesce(s.value, d.value) AS value FROM d LEFT JOIN s ON s.key = d.key""")
def config_overlay(spark, folder):
    events, docs = views.table(spark, folder, "events"), views.table(spark, folder, "documents")
    defaults = events.select(F.col("event_type").alias("key")).distinct().withColumn(
        "value", F.concat(F.lit("default "), "key"))
    stored = events.where("event_type < 'q'").groupBy(F.col("event_type").alias("key")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    other = docs.select(F.col("lang").alias("key")).distinct().withColumn("value", F.lit("unknown key"))
    return search.tree_overlay(defaults, stored.unionByName(other))


PAIRS = """SELECT a.tid AS src, b.tid AS dst,
                  list_dot_product(a.vec, b.vec)
                  / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS w
           FROM vecs a JOIN vecs b ON a.tid <> b.tid"""


@query("cosine_pairs", f"SELECT src, dst, round(w, 6) AS w FROM ({PAIRS}) p WHERE w >= 0.3")
def cosine_pairs(spark, folder):
    return similarity.cosine_pairs(views.vecs(spark, folder), 0.3).select(
        "src", "dst", F.round("w", 6).alias("w"))


@query("vector_copies", "SELECT tid, min(tid) OVER (PARTITION BY vec) AS rep FROM vecs_copied")
def vector_copies(spark, folder):
    """The name that each vector has in the pairs."""
    return similarity.copies_of(views.vecs_copied(spark, folder))


@query("cosine_pairs_approx")
def cosine_pairs_approx(spark, folder):
    return similarity.cosine_pairs_approx(views.vecs(spark, folder), 0.3).select("src", "dst", F.round("w", 6).alias("w"))
