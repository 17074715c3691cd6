"""Change streams, pulls, refreshed searches and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, tables
from ..plans.shared import fresh_path
from ..sources import remote
from ..streaming import changes, live
from . import views
from .reads import TAG_SQL, tags
from .registry import query
from .sqlviews import ts

LAST_OP = """last AS (SELECT * FROM cdc_events QUALIFY row_number() OVER (PARTITION BY tid ORDER BY seq DESC) = 1)"""
# The table before the stream: one row for each author of orders, some of them users.
START = "start AS (SELECT o_custkey AS tid, 'start' AS txt FROM orders GROUP BY 1)"


def _start(spark, folder):
    keys = views.table(spark, folder, "orders").select(F.col("o_custkey").alias("tid")).distinct()
    return keys.select(
        "tid", F.lit("start").alias("txt"), F.lit("cust").alias("ref"), F.array(F.lit("start")).alias("sts"),
        views.at("2023-12-31 00:00:00").alias("dt"), F.lit("user").alias("type"),
        F.lit(None).cast("timestamp").alias("modAt"), F.lit(None).cast("string").alias("rec"),
        F.concat(F.lit("e"), F.col("tid").cast("string")).alias("entry_id"))


@query("cdc_apply", f"""
    WITH {LAST_OP}, {START}
    SELECT tid, printf('%.2f', value) AS txt, {ts('ts')} AS dt FROM last WHERE op <> 'DELETE'
    UNION ALL SELECT tid, txt, '2023-12-31 00:00:00.000000' FROM start WHERE tid NOT IN (SELECT tid FROM last)""")
def cdc_apply(spark, folder):
    """The events as a stream, stored batch by batch, then folded into the table."""
    root = fresh_path(spark, "cdc")
    stream = views.cdc_events(spark, folder, views.stream_events(spark, folder))
    changes.write_changes(stream, root, fresh_path(spark, "checkpoint")).awaitTermination()
    return changes.current_table(_start(spark, folder), root).select("tid", "txt", "dt")


@query("cdc_bootstrap", f"""
    WITH {LAST_OP}, {START}
    SELECT tid, txt, '2023-12-31 00:00:00.000000' AS dt FROM start WHERE tid NOT IN (SELECT tid FROM last)
    UNION ALL SELECT tid, printf('%.2f', value) AS txt, {ts('ts')} AS dt FROM last WHERE op <> 'DELETE'""")
def cdc_bootstrap(spark, folder):
    """A load taken half-way, then the stored changes after its position: the same table.

    The log holds two streams that overlap, and changes from before the load's position.
    """
    every = views.cdc_events(spark, folder)
    half = every.agg(F.max("seq").alias("m")).first()["m"] // 2
    loaded = changes.apply_changes(_start(spark, folder), every.where(F.col("seq") <= half))
    root, streamed = fresh_path(spark, "cdc"), views.cdc_events(spark, folder, views.stream_events(spark, folder))
    for part in (F.col("seq") <= half + half // 2, F.col("seq") > half // 2):
        changes.write_changes(streamed.where(part), root, fresh_path(spark, "checkpoint")).awaitTermination()
    return changes.current_table(loaded, root, half).select("tid", "txt", "dt")


@query("incremental_pull", f"SELECT {TAG_SQL} FROM tags_documents WHERE dt > TIMESTAMP '2024-01-16'")
def incremental_pull(spark, folder):
    docs = views.tags_documents(spark, folder)
    mark = live.high_water_mark(docs.where("dt <= timestamp'2024-01-16'"))
    return tags(live.incremental_pull(docs, mark))


@query("live_query", """
    SELECT tid, txt FROM tags_events WHERE list_contains(sts, 'signup') ORDER BY tid DESC LIMIT 555""")
def live_query(spark, folder):
    """The table as it was half-way, read once; then all events as changes of it."""
    target, rows = fresh_path(spark, "live"), views.tags_events(spark, folder)
    half = rows.agg(F.max("tid").alias("m")).first()["m"] // 2
    events = views.stream_events(spark, folder).select(
        F.col("event_id").alias("seq"), F.lit("INSERT").alias("op"), F.col("event_id").alias("tid"),
        F.col("event_type").alias("txt"), F.array("event_type").alias("sts"), F.lit(None).cast("string").alias("entry_id"))
    live.live_query(events, lambda found: search.filter_all_tags(found, ["signup"]).select("tid", "txt"), target,
                    fresh_path(spark, "checkpoint"), load=lambda: rows.where(F.col("tid") <= half)).awaitTermination()
    results = spark.read.schema("tid bigint, txt string, result long").parquet(target)
    return results.where(F.col("result") == results.select(F.max("result")).scalar()).select("tid", "txt")


@query("debounce_events", """
    SELECT key, id, value FROM (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, id) AS nxt FROM bursts) b
    WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000 OR value = 0""")
def debounce_events(spark, folder):
    return live.debounce_events(views.bursts(spark, folder), 3600).select("key", "id", "value")


@query("debounce_stream", f"""
    WITH b AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, id) AS nxt FROM bursts),
    mark AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS ms FROM bursts)
    SELECT key, id, {ts('ts')} AS ts, value FROM b, mark
    WHERE value = 0 OR ((nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000) AND epoch_us(ts) + 3600000000 <= ms * 1000)""")
def debounce_stream(spark, folder):
    """Zero values, and bursts that the final watermark, a minute before the last row, has closed."""
    target = fresh_path(spark, "debounce")
    events = views.stream_events(spark, folder).select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "value")
    closed = live.debounce_stream(events, "1 hour")
    (closed.writeStream.format("parquet").option("path", f"{target}/out")
     .option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("key bigint, ts timestamp, id bigint, value double").parquet(f"{target}/out")


@query("audit_columns", """
    WITH old AS (SELECT 'doc/' || doc_id AS key, lang AS value FROM documents),
         new AS (SELECT 'doc/' || doc_id * 3 AS key, CASE WHEN toxic = 1 THEN 'toxic' END AS value FROM labels)
    SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value,
           CASE WHEN o.key IS NOT NULL THEN '2024-01-01 00:00:00.000000' ELSE '2024-05-01 12:00:00.000000' END AS "addAt",
           CASE WHEN n.key IS NOT NULL THEN '2024-05-01 12:00:00.000000' ELSE '2024-01-01 00:00:00.000000' END AS "modAt"
    FROM old o FULL JOIN new n ON o.key = n.key""")
def audit_columns(spark, folder):
    stamp = views.at("2024-01-01 00:00:00")
    old = views.table(spark, folder, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("value"),
        stamp.alias("addAt"), stamp.alias("modAt"))
    new = views.table(spark, folder, "labels").select(
        F.concat(F.lit("doc/"), (F.col("doc_id") * 3).cast("string")).alias("key"),
        F.when(F.col("toxic") == 1, "toxic").alias("value"))
    return tables.audit_columns(old, new, views.NOW)


@query("upload_queue", """
    SELECT event_id AS tid, event_type AS txt, 'user-1' AS user_id FROM events""")
def upload_queue(spark, folder):
    target = fresh_path(spark, "upload")
    rows = views.stream_events(spark, folder).select(
        F.col("event_id").alias("tid"), F.col("event_type").alias("txt"), F.lit("e").alias("ref"),
        F.array("event_type").alias("sts"), F.col("ts").alias("dt"), F.lit("event").alias("type"))
    push = lambda df: remote.push_rows(df.withColumn("tid", F.col("tid") + 1), "user-1")
    live.upload_queue(rows, push, target, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("tid bigint, txt string, user_id string, batch long").parquet(target).select(
        (F.col("tid") - 1).alias("tid"), "txt", "user_id")
