"""Merging of rows, texts, tags and records; whole sync rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.merge import merge3_tags, merge3_text, rec_merge
from ..operators import sync, tables
from ..plans.sync_round import sync_once
from ..schema import tag_struct
from . import views
from .registry import query
from .sqlviews import joined, ts


@query("merge_row", f"""
    SELECT l.tid, CASE WHEN patch THEN 'server ' || origin_txt || ' local' ELSE l.txt END AS txt,
           l.ref, {joined('l.sts')} AS sts, {ts('l.b_dt')} AS dt, l.dirty,
           CASE WHEN patch THEN 'server' END AS note, CASE WHEN patch THEN 'kept' END AS mine
    FROM (SELECT l.*, b.dt AS b_dt, l.has_origin AND l.origin_dt = b.prev_dt AS patch
          FROM local_sync l JOIN base b ON b.type = l.type AND b.ref = l.ref) l""")
def merge_row(spark, folder):
    mine = views.local_sync(spark, folder).select("type", "ref", tag_struct().alias("mine"))
    theirs = views.base(spark, folder).select("type", "ref", tag_struct().alias("theirs"))
    merged = sync.merge_row(F.col("mine"), F.col("theirs"), views.at(views.NOW))
    return mine.join(theirs, ["type", "ref"]).select(merged.alias("m")).select(
        "m.tid", "m.txt", "m.ref", "m.sts", "m.dt", F.col("m.modAt").isNotNull().alias("dirty"),
        F.get_json_object("m.rec", "$.note").alias("note"), F.get_json_object("m.rec", "$.mine").alias("mine"))


@query("merge3_text", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'base ' || text WHEN 1 THEN text || ' mine'
           WHEN 2 THEN 'theirs: ' || text || ' (mine)' WHEN 3 THEN text || ' [mine] [theirs]'
           ELSE '¶' || text[2:] END AS merged FROM documents""")
def merge3_text_(spark, folder):
    text, case = F.col("text"), F.col("doc_id") % 5
    rest = F.substring(text, F.lit(2), F.length(text))

    def pick(*values):
        out = F.when(case == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(case == i, value)
        return out

    mine = pick(text, F.concat(text, F.lit(" mine")), F.concat(text, F.lit(" (mine)")),
                F.concat(text, F.lit(" [mine]")), F.concat(F.lit("§"), rest))
    theirs = pick(F.concat(F.lit("base "), text), text, F.concat(F.lit("theirs: "), text),
                  F.concat(text, F.lit(" [theirs]")), F.concat(F.lit("¶"), rest))
    return views.table(spark, folder, "documents").select("doc_id", "text").repartition("doc_id").select(
        "doc_id", merge3_text(text, mine, theirs).alias("merged"))


@query("merge3_tags", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'mine|' || source || '|theirs' WHEN 1 THEN lang || '|theirs'
           WHEN 2 THEN lang || '|' || source || '|theirs|mine' ELSE '' END AS merged FROM documents""")
def merge3_tags_(spark, folder):
    case, lang, source = F.col("doc_id") % 4, F.col("lang"), F.col("source")
    mine = (F.when(case == 0, F.array(F.lit("mine"), source)).when(case == 1, F.array(lang))
            .when(case == 2, F.array(lang, source, F.lit("mine"))))
    theirs = F.when(case < 3, F.array(lang, source, F.lit("theirs"))).otherwise(F.array(lang, source))
    return views.table(spark, folder, "documents").select(
        "doc_id", merge3_tags(F.array(lang, source), mine, theirs).alias("merged"))


@query("rec_merge", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS plain, 'null' AS gone,
           '[1,2,3]' AS list, CAST(user_id AS VARCHAR) AS mine, 'yes' AS theirs,
           '{"y":2}' AS replaced FROM events""")
def rec_merge_(spark, folder):
    events = views.table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "props").repartition("event_id")
    target = F.concat(F.lit('{"plain":0,"gone":1,"list":[1,2],"o":{"mine":'), F.col("user_id").cast("string"),
                      F.lit('},"replaced":[5],"k":"old"}'))
    source = F.concat(F.lit('{"gone":null,"list":[3],"o":{"theirs":"yes","k":'),
                      F.get_json_object("props", "$.k"), F.lit('},"replaced":{"y":2},"plain":"'),
                      F.col("event_type"), F.lit('"}'))
    merged = F.col("merged")

    def field(path, name):
        return F.variant_get(merged, path, "string").alias(name)

    return events.select("event_id", F.parse_json(rec_merge(target, source, 3)).alias("merged")).select(
        "event_id", field("$.o.k", "k"), field("$.plain", "plain"),
        F.to_json(F.variant_get(merged, "$.gone", "variant")).alias("gone"),
        F.to_json(F.variant_get(merged, "$.list", "variant")).alias("list"), field("$.o.mine", "mine"),
        field("$.o.theirs", "theirs"), F.to_json(F.variant_get(merged, "$.replaced", "variant")).alias("replaced"))


@query("reassign_pk", """
    SELECT ref, type, txt, (SELECT max(tid) FROM tags_documents)
           + row_number() OVER (ORDER BY type, ref) AS tid FROM local_snap""")
def reassign_pk(spark, folder):
    top = views.tags_documents(spark, folder).agg(F.max("tid").alias("t")).first()["t"]
    return tables.reassign_pk(views.local_snap(spark, folder), ["type", "ref"], top).select(
        "ref", "type", "txt", "tid")


@query("sync_round", f"""
    WITH l AS (SELECT *, tid % 20 AS k FROM local_sync),
    d AS (SELECT *, tid % 20 AS k FROM tags_documents),
    top AS (SELECT max(tid) AS t FROM tags_documents),
    settled AS (
        SELECT tid, CASE k WHEN 8 THEN 'server ' || origin_txt || ' local' WHEN 3 THEN txt || ' v2' ELSE txt END AS txt,
               CASE k WHEN 13 THEN 'moved/' || tid ELSE ref END AS ref, sts,
               CASE WHEN k = 0 THEN TIMESTAMP '2024-05-01 12:00:00' WHEN k IN (1, 8) THEN dt + INTERVAL 1 DAY
                    WHEN k IN (3, 13) THEN TIMESTAMP '2024-03-01' ELSE dt END AS dt,
               type, k IN (1, 2, 4, 8) AS dirty FROM l),
    moved AS (SELECT top.t + row_number() OVER (ORDER BY type, ref) AS tid, txt, ref, sts, dt, type, TRUE AS dirty
              FROM d, top WHERE k = 13)
    SELECT tid, txt, ref, {joined('sts')} AS sts, {ts('dt')} AS dt, type, dirty FROM
        (SELECT * FROM settled UNION ALL SELECT * FROM moved) x""")
def sync_round(spark, folder):
    done = sync_once(views.base(spark, folder, newer=True), views.local_sync(spark, folder), views.NOW)
    return done.local.select("tid", "txt", "ref", "sts", "dt", "type",
                             F.col("modAt").isNotNull().alias("dirty"))
