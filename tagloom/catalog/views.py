"""Inputs derived from the given tables, each from all of their rows.

Copies that differ (two devices, a server and a client) come from one table by rules on
its ids: rows are edited, renamed or moved to another key, never left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import as_tags

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}
NOW = "2024-05-01 12:00:00"
NEWER = "2024-03-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _days(n: Column) -> Column:
    return F.make_interval(days=n.cast("int"))


def _documents_as_tags(spark: SparkSession, folder: str, ref: Column) -> DataFrame:
    docs = table(spark, folder, "documents")
    return as_tags(docs.select(
        F.col("doc_id").alias("tid"), F.col("text").alias("txt"), ref.alias("ref"),
        F.array("lang", "source").alias("sts"),
        (at("2024-01-01 00:00:00") + _days(F.col("doc_id") % 30)).alias("dt"),
        F.col("lang").alias("type")))


def tags_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _documents_as_tags(spark, folder, F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))


def tags_dups(spark: SparkSession, folder: str) -> DataFrame:
    return _documents_as_tags(spark, folder, F.col("source"))


def tags_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return as_tags(events.select(
        F.col("event_id").alias("tid"), F.col("event_type").alias("txt"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("ref"),
        F.array("event_type", F.concat(F.lit("dev_"), (F.col("event_id") % 4).cast("string"))).alias("sts"),
        F.date_trunc("day", "ts").alias("dt"), F.col("event_type").alias("type")))


def tags_pages(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("tid"),
        F.concat(title, F.lit(" #"), lang, F.lit(" - "), host).alias("txt"),
        F.col("url").alias("ref"), F.array(lang, host).alias("sts"), F.lit("tab").alias("type"))


def server_snap(spark: SparkSession, folder: str) -> DataFrame:
    return tags_documents(spark, folder)


def local_snap(spark: SparkSession, folder: str) -> DataFrame:
    """Per ten rows: one edited, one replaced by a local row, one kept under another key."""
    tid, rest = F.col("tid"), F.col("tid") % 10
    return tags_documents(spark, folder).select(
        F.when(rest.isin(8, 9), -tid - 1).otherwise(tid).alias("tid"),
        F.when(rest == 5, F.concat("txt", F.lit(" edited"))).otherwise(F.col("txt")).alias("txt"),
        F.when(rest == 8, F.concat(F.lit("local/"), tid.cast("string"))).otherwise(F.col("ref")).alias("ref"),
        "sts", "dt", "type", "modAt", "rec")


def _iso(dt: Column) -> Column:
    return F.date_format(dt, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def base(spark: SparkSession, folder: str, newer: bool = False) -> DataFrame:
    """Server table. With ``newer``, two rows in twenty changed after every local time."""
    tid, five, twenty = F.col("tid"), F.col("tid") % 5, F.col("tid") % 20
    day = F.expr("interval 1 day")
    text = F.when(twenty == 8, F.concat(F.lit("server "), "txt"))
    ref = F.when(five == 4, F.concat(F.lit("server/"), tid.cast("string")))
    dt = F.col("dt")
    if newer:
        text = text.when(twenty == 3, F.concat("txt", F.lit(" v2")))
        ref = ref.when(twenty == 13, F.concat(F.lit("moved/"), tid.cast("string")))
        dt = F.when(twenty.isin(3, 13), at(NEWER)).otherwise(dt)
    return tags_documents(spark, folder).select(
        F.when(five == 4, -tid - 1).otherwise(tid).alias("tid"),
        text.otherwise(F.col("txt")).alias("txt"), ref.otherwise(F.col("ref")).alias("ref"),
        "sts", dt.alias("dt"), "type", "modAt",
        F.to_json(F.struct(_iso(F.col("dt") - day).alias("prev_dt"), F.lit("server").alias("note"))).alias("rec"))


def local_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Client table; by id mod 20: 0 edited in step, 1 edited on stale time, 2 and 4 made
    here, 8 edited on stale time with the copy it was edited from, others as stored."""
    tid, rest = F.col("tid"), F.col("tid") % 20
    day = F.expr("interval 1 day")
    origin = F.to_json(F.struct(
        F.struct(_iso(F.col("dt") - day).alias("dt"), F.col("txt"), F.col("sts")).alias("b4mod"),
        F.lit("local").alias("note"), F.lit("kept").alias("mine")))
    return tags_documents(spark, folder).select(
        "tid",
        F.when(rest.isin(0, 1, 8), F.concat("txt", F.lit(" local"))).otherwise(F.col("txt")).alias("txt"),
        F.when(rest == 2, F.concat(F.lit("local/"), tid.cast("string"))).otherwise(F.col("ref")).alias("ref"),
        "sts",
        F.when(rest.isin(1, 8), F.col("dt") - day).when(~rest.isin(2, 4), F.col("dt")).alias("dt"),
        "type", F.when(rest.isin(0, 1, 2, 4, 8), at(NOW)).alias("modAt"),
        F.when(rest == 8, origin).otherwise(F.lit("{}")).alias("rec"))


def remote_rt(spark: SparkSession, folder: str) -> DataFrame:
    return tags_documents(spark, folder).select(
        F.concat(F.lit("e"), F.col("tid").cast("string")).alias("entry_id"), "tid", "txt", "ref",
        "type", "sts", F.array("tid").alias("ats"), _iso(F.col("dt")).alias("dt"))


def cdc_events(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Changes of a table with one row per user; deletes name the entry alone. Also on a stream of events."""
    events = table(spark, folder, "events") if events is None else events
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("op"),
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entry_id"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("tid"), F.format_string("%.2f", "value").alias("txt"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("ref"),
        F.array("event_type").alias("sts"), F.col("ts").cast("timestamp").alias("dt"),
        F.lit("user").alias("type"), F.lit(None).cast("timestamp").alias("modAt"),
        F.lit(None).cast("string").alias("rec"))


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet")
            .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))


def durations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("scope"), "ts", F.col("event_id").alias("id"), F.col("value").alias("ms"))


def bursts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "value")


def vecs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("tid"), F.col("embedding").alias("vec"))


def vecs_copied(spark: SparkSession, folder: str) -> DataFrame:
    """Every third id has the first vector, and every tenth vector stands under a second id."""
    rows = vecs(spark, folder)
    first = rows.agg(F.min_by("vec", "tid").alias("v")).first()["v"]  # one vector
    hot = F.array(*(F.lit(x) for x in first or [])).cast("array<float>")
    held = rows.withColumn("vec", F.when(F.col("tid") % 3 == 0, hot).otherwise(F.col("vec")))
    return held.unionByName(held.where("tid % 10 = 1").withColumn("tid", -F.col("tid") - 1))


def models(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors as those of two models, by id."""
    return vecs(spark, folder).withColumn("mdl", F.when(F.col("tid") % 3 == 0, "small").otherwise("large"))


def md_links(spark: SparkSession, folder: str) -> DataFrame:
    """One markdown document per host: here a document is one page's line."""
    number = F.when(F.col("page_id") % 3 == 2, F.lit("1. ")).otherwise(F.lit(""))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select("page_id", F.concat(
        F.lit("saved pages\n"), number, F.lit("["), title, F.lit("]("), F.col("url"), F.lit(")\nend")).alias("text"))


def md_documents(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.array(F.lit("# "), F.lit("- "), F.lit("> "), F.lit(""))
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.transform(
        F.split("text", "\n"), lambda line, i: F.concat(F.get(mark, i % 4), line)), "\n").alias("text"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.concat(
        F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"p":'), F.col("props"),
        F.lit(',"kinds":["'), F.col("event_type"), F.lit('",{"z":1,"a":null}]}')).alias("record"))

