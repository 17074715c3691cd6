"""Change streams: apply inserts, updates and deletes to a table of tags.

Each micro-batch is reduced to the last change of every key and written under its batch
number, which makes a repeated batch harmless. A log per stream tells which files hold
which span of ``seq``. Of ``FAN`` entries of one level one of the next level is made, with
the last change of each key, in ranges of keys; so a change is written again once per
level, and however many batches came, a read opens a few entries per level. A read from a
position on opens only entries that go beyond it. The current table is the base with
those changes folded in; ``compact`` turns the two into a new base and its position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.shared import latest_version, store_version
from ..schema import CHANGES, TAG_COLUMNS

DELETE = "DELETE"
# Entries of a level of the log that become one of the next; rows of a range of keys.
FAN = 8
ROWS_PER_RANGE = 1 << 20

LOG = T.StructType([
    T.StructField("level", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("first", T.LongType()),
    T.StructField("last", T.LongType()),
    T.StructField("n", T.LongType()),
])


def change_key() -> Column:
    """A row's identity: its ``tid``, else its ``entry_id``."""
    return F.coalesce(F.col("tid").cast("string"), F.concat(F.lit("entry:"), F.col("entry_id")))


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each key. Combines before the shuffle, so hot keys stay cheap."""
    return (changes.groupBy(change_key().alias("_key"))
            .agg(F.max_by(F.struct(*changes.columns), "seq").alias("c")).select("c.*"))


def known_tids(changes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """entry_id, known: the ``tid`` of each entry that is named by its entry alone somewhere.

    Table and changes tell it where they have both; the larger, should they differ.
    """
    named = [t for t in (changes, tags) if t is not None]
    alone, both = None, None
    for t in named:
        a = t.where("tid IS NULL AND entry_id IS NOT NULL").select("entry_id")
        b = t.where("tid IS NOT NULL AND entry_id IS NOT NULL").select("entry_id", "tid")
        alone, both = (a, b) if alone is None else (alone.union(a), both.union(b))
    return both.join(alone.distinct(), "entry_id", "left_semi").groupBy("entry_id").agg(F.max("tid").alias("known"))


def _identified(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with ``_id``, their ``tid`` or what is known of it. Few rows lack one; only they are joined."""
    lack = F.col("tid").isNull() & F.col("entry_id").isNotNull()
    found = rows.where(lack).join(known, "entry_id", "left").select(*rows.columns, F.col("known").alias("_id"))
    return rows.where(~lack).withColumn("_id", F.col("tid")).unionByName(found)


def apply_changes(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after all changes, in order of ``seq``; the later change of a row wins.

    A row is known by its ``tid``, by its ``entry_id``, or by both: a change that names
    only the entry meets the row that has the entry's ``tid``. ``tags`` may carry
    ``entry_id``; without it, entries are known from the changes alone.
    """
    has_entry = "entry_id" in tags.columns
    known = known_tids(changes, tags if has_entry else None)
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("entry:"), F.col("entry_id")))
    latest = (_identified(changes, known).groupBy(key.alias("_key"))
              .agg(F.max_by(F.struct(*changes.columns, "_id"), "seq").alias("c")).select("_key", "c.*")
              .withColumn("tid", F.coalesce("tid", "_id")))
    out = [*TAG_COLUMNS, "entry_id"] if has_entry else TAG_COLUMNS
    own = _identified(tags, known).withColumn("_key", key) if has_entry else tags.withColumn("_key", F.col("tid").cast("string"))
    kept = own.join(latest.select("_key"), "_key", "left_anti").select(*out)
    return kept.unionByName(latest.where(F.col("op") != DELETE).select(*out))


def bootstrap(initial: DataFrame, changes: DataFrame, from_seq: int) -> DataFrame:
    """Initial load, then only the changes after the position it was taken at."""
    return apply_changes(initial, changes.where(F.col("seq") > from_seq))


def write_changes(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream that stores each batch's last changes under ``root``."""
    # A new checkpoint counts its batches from 0 again; its name keeps them apart.
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, own, log = batch.sparkSession, f"{root}/changes/stream={name}", f"{root}/log/stream={name}"
        before = latest_version(spark, log, LOG, batch_id)
        entries = [] if before is None else before.where("path IS NOT NULL").collect()
        entries += _entry(last_changes(batch), f"{own}/batch={batch_id}", 0)
        entries = _levelled(spark, entries, lambda level: f"{own}/level={level}/batch={batch_id}")
        # A log without entries is a version too.
        told = [tuple(e) for e in entries] or [(None,) * len(LOG.fields)]
        store_version(spark.createDataFrame(told, LOG).coalesce(1), log, batch_id, LOG)

    return (stream.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _entry(rows: DataFrame, path: str, level: int) -> list[tuple]:
    """Write changes as an entry of the log; none if there are none."""
    rows.write.mode("overwrite").parquet(path)
    span = rows.sparkSession.read.schema(CHANGES).parquet(path).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n")).first()
    return [(level, path, span["first"], span["last"], span["n"])] if span["n"] else []


def _levelled(spark: SparkSession, entries: list, path: Callable[[int], str]) -> list:
    """Entries after every level that has ``FAN`` of them became one of the next."""
    level = 0
    while level <= max((e[0] for e in entries), default=-1):
        own = [e for e in entries if e[0] == level]
        if len(own) >= FAN:
            rows = last_changes(spark.read.schema(CHANGES).parquet(*(e[1] for e in own)))
            parts = max(1, math.ceil(sum(e[4] for e in own) / ROWS_PER_RANGE))
            ranged = rows.repartitionByRange(parts, change_key()) if parts > 1 else rows.coalesce(1)
            entries = [e for e in entries if e[0] != level] + _entry(ranged, path(level + 1), level + 1)
        level += 1
    return entries


def log_entries(spark: SparkSession, root: str) -> list:
    """Entries of all streams' newest logs: at most ``FAN`` - 1 for each level and stream."""
    full = T.StructType([*LOG.fields]).add("_version", "long").add("stream", "string")
    try:
        rows = spark.read.schema(full).option("basePath", f"{root}/log").parquet(f"{root}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = rows.groupBy("stream").agg(F.max("_version").alias("_version"))
    return rows.join(newest, ["stream", "_version"]).where("path IS NOT NULL").select(*LOG.fieldNames()).collect()


def stored_changes(spark: SparkSession, root: str, from_seq: int | None = None) -> DataFrame:
    """Stored changes, those after ``from_seq`` where it is given. Files of older ones are not opened."""
    paths = [e["path"] for e in log_entries(spark, root) if from_seq is None or e["last"] > from_seq]
    if not paths:
        return spark.createDataFrame([], CHANGES)
    rows = spark.read.schema(CHANGES).parquet(*paths)
    return rows if from_seq is None else rows.where(F.col("seq") > from_seq)


def current_table(base: DataFrame, root: str, from_seq: int | None = None) -> DataFrame:
    """``base`` with the stored changes, those after ``from_seq`` where it is given."""
    return apply_changes(base, stored_changes(base.sparkSession, root, from_seq))


def compact(base: DataFrame, root: str, target: str, from_seq: int | None = None) -> tuple[DataFrame, int | None]:
    """Write base and stored changes as a new base; returns it and its position.

    The position is the last ``seq`` folded in: reading from there on leaves out what the
    new base holds. It is taken first, so a change that comes meanwhile is read again,
    which changes nothing. The old files stay until removed.
    """
    last = max((e["last"] for e in log_entries(base.sparkSession, root)), default=None)
    position = last if last is not None else from_seq
    current_table(base, root, from_seq).write.parquet(target)
    return base.sparkSession.read.schema(base.schema).parquet(target), position


def latest_by_key_stream(stream: DataFrame) -> DataFrame:
    """The last change of each key as running state, for update or complete mode."""
    return last_changes(stream)
