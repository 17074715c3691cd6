"""Counts, statistics and durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from . import views
from .reads import TAG_SQL, tags
from .registry import query
from .sqlviews import ts

DAY = ts("dt")


@query("table_counts", """
    SELECT 'tags' AS name, count(*) AS n, max(doc_id) AS max_tid FROM documents
    UNION ALL SELECT 'stat', count(*), max(event_id) FROM events
    UNION ALL SELECT 'vecs', count(*), max(vec_id) FROM embeddings
    UNION ALL SELECT 'tree', count(*), NULL FROM labels""")
def table_counts(spark, folder):
    return stats.table_counts({
        "tags": views.tags_documents(spark, folder),
        "stat": views.table(spark, folder, "events").withColumnRenamed("event_id", "tid"),
        "vecs": views.vecs(spark, folder),
        "tree": views.table(spark, folder, "labels"),
    })


@query("max_tid", "SELECT max(tid) AS max_tid FROM tags_events")
def max_tid(spark, folder):
    return stats.max_tid(views.tags_events(spark, folder))


@query("last_by_dt", f"SELECT {TAG_SQL} FROM tags_documents ORDER BY dt DESC, tid DESC LIMIT 1")
def last_by_dt(spark, folder):
    return tags(stats.last_by_dt(views.tags_documents(spark, folder)))


@query("count_by_ref_type", "SELECT ref, type, count(*) AS n FROM tags_dups GROUP BY ref, type")
def count_by_ref_type(spark, folder):
    return stats.count_by_ref_type(views.tags_dups(spark, folder))


@query("duplicate_report", f"""
    SELECT ref, type, count(*) AS n, {ts('min(dt)')} AS first_dt, {ts('max(dt)')} AS last_dt
    FROM tags_dups GROUP BY ref, type HAVING count(*) > 1""")
def duplicate_report(spark, folder):
    return stats.duplicate_report(views.tags_dups(spark, folder))


@query("update_stats", f"""
    WITH src AS (SELECT * FROM tags_events UNION ALL
                 SELECT tid + 1000000, txt, ref, sts, TIMESTAMP '2024-02-01' + to_seconds(CAST(tid AS INTEGER)), type
                 FROM tags_documents),
    g AS (SELECT dt, count(*) AS n, max(tid) AS max_tid,
                 CASE WHEN count(*) = 1 THEN min(type || ': ' || txt || ' #' || array_to_string(sts, ', #')) END AS detail
          FROM src GROUP BY dt ORDER BY dt DESC LIMIT 11)
    SELECT {DAY} AS dt, strftime(dt, '%Y ') || lpad(CAST(month(dt) AS VARCHAR), 2, ' ')
           || strftime(dt, '/%d %a %H:%M') AS shown, n, max_tid,
           (epoch_ms(TIMESTAMP '2024-05-01 12:00:00') - epoch_ms((SELECT max(dt) FROM src))) / CAST(86400000 AS DOUBLE)
               AS days_since_newest,
           replace(detail, ', #', ', #') AS detail FROM g""")
def update_stats(spark, folder):
    """Days of events, and documents a second apart: times of many rows and of one."""
    documents = views.tags_documents(spark, folder).withColumn(
        "dt", views.at("2024-02-01 00:00:00") + F.make_interval(secs=F.col("tid"))).withColumn(
        "tid", F.col("tid") + 1_000_000)
    return stats.update_stats(
        views.tags_events(spark, folder).unionByName(documents), views.NOW,
    )


@query("top_tags", f"""
    WITH c AS (SELECT dt, tag, count(*) AS n FROM (SELECT dt, unnest(sts) AS tag FROM tags_events) e
               WHERE NOT starts_with(tag, 'dev_') GROUP BY dt, tag)
    SELECT {DAY} AS dt, tag, n, row_number() OVER (PARTITION BY dt ORDER BY n DESC, tag) AS rank FROM c
    QUALIFY rank <= 3""")
def top_tags(spark, folder):
    return stats.top_tags(views.tags_events(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


@query("dev_tag_counts", f"""
    SELECT {DAY} AS dt, tag[5:] AS tag, count(*) AS n FROM (SELECT dt, unnest(sts) AS tag FROM tags_events) e
    WHERE starts_with(tag, 'dev_') GROUP BY dt, tag""")
def dev_tag_counts(spark, folder):
    return stats.dev_tag_counts(views.tags_events(spark, folder))


@query("sum_values", "SELECT round(sum(value), 4) AS total FROM events")
def sum_values(spark, folder):
    return stats.sum_values(views.table(spark, folder, "events"), "value").select(
        F.round("total", 4).alias("total"))


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, folder):
    return stats.distinct_values(views.table(spark, folder, "documents"), ["lang", "source"])


@query("ema_duration", """
    SELECT scope, round(list_reduce(list(ms ORDER BY ts, id), lambda a, x: a * 0.5 + x * 0.5), 6) AS ema,
           count(*) AS n FROM durations GROUP BY scope""")
def ema_duration(spark, folder):
    return stats.ema_duration(views.durations(spark, folder)).withColumn("ema", F.round("ema", 6))


@query("max_duration", """
    SELECT scope, id, ms, max(ms) OVER (PARTITION BY scope ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS max_ms
    FROM durations""")
def max_duration(spark, folder):
    return stats.max_duration(views.durations(spark, folder)).select("scope", "id", "ms", "max_ms")
