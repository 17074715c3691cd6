"""Pulls above a high-water mark, refreshed searches, bursts and upload queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import SEARCH_ROWS, newest
from ..plans.ordered import with_next
from ..plans.shared import latest_version, store_version
from .changes import DELETE, last_changes

# Fixed value: pause, in seconds, that ends a burst.
BURST_GAP = 0.4


def incremental_pull(tags: DataFrame, mark) -> DataFrame:
    """Rows changed after the mark; all rows when there is none. ``dt`` is filtered in the scan."""
    return tags if mark is None else tags.where(F.col("dt") > F.lit(mark).cast("timestamp"))


def high_water_mark(tags: DataFrame):
    """Latest time of a table, one value on the driver."""
    return tags.agg(F.max("dt").alias("m")).first()["m"]


def live_query(stream: DataFrame, search: Callable[..., DataFrame], target: str, checkpoint: str,
               load: Callable[[], DataFrame] | None = None, limit: int = SEARCH_ROWS, reserve: int = SEARCH_ROWS,
               **trigger) -> StreamingQuery:
    """Keep the newest result of a search while rows arrive; batch n writes ``target/result=n``.

    With ``load`` the result is maintained: ``search(rows)`` picks the matching rows of any
    rows, ``load()`` is the table as it is, and the stream carries its changes (``seq``, ``op``,
    ``tid``, ...). The newest ``limit + reserve`` hits are the state. A batch takes its
    changed keys out and its own hits in, so it costs what it and the state hold; the table
    is read at the start, and again when deletions have used up the reserve or a change
    does not tell its ``tid``.

    Without it ``search()`` reads the table itself and runs again with every batch; the
    arriving rows only say that it changed.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        found = search() if load is None else _maintained(batch, batch_id, search, load, f"{target}/_state", limit, reserve)
        found.write.mode("overwrite").parquet(f"{target}/result={batch_id}")

    return (stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _maintained(batch: DataFrame, batch_id: int, search: Callable[[DataFrame], DataFrame], load: Callable[[], DataFrame],
                path: str, limit: int, reserve: int) -> DataFrame:
    """The state after a batch, stored for the next; returns its newest ``limit`` rows.

    A marker row says whether the table may hold more hits, all below ``_floor``.
    """
    found = search(batch).schema
    columns, full = found.fieldNames(), _state_schema(found)
    held_rows = [last_changes(batch).persist()]
    changed = held_rows[0]
    told_all = changed.where("tid IS NULL").isEmpty()

    def scanned():
        rows = newest(search(load()).select(*columns), limit + reserve).persist()
        held_rows.append(rows)
        told = _facts(rows)
        return rows, told["n"] == limit + reserve, told["floor"]

    def applied(rows: DataFrame, more: bool, floor):
        hits = search(changed.where(F.col("op") != DELETE)).select(*columns)
        if more:
            hits = hits.where(F.col("tid") >= floor)
        kept = rows.join(changed.select("tid"), "tid", "left_anti").select(*columns)
        rows = newest(kept.unionByName(hits), limit + reserve).persist()
        held_rows.append(rows)
        return rows, _facts(rows)

    held = latest_version(batch.sparkSession, path, full, batch_id)
    if held is None or not told_all:
        fresh, base = True, scanned()
    else:
        marker = held.where("_marker").first()
        fresh, base = False, (held.where("NOT _marker").select(*columns), marker["_more"], marker["_floor"])
    rows, told = applied(*base)
    if base[1] and told["n"] < limit and not fresh:
        base = scanned()
        rows, told = applied(*base)
    more = base[1] or told["n"] == limit + reserve
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.fields]
    marker = batch.sparkSession.range(1).select(
        *none, F.lit(True).alias("_marker"), F.lit(more).alias("_more"), F.lit(told["floor"]).cast("long").alias("_floor"))
    state = rows.select("*", F.lit(False).alias("_marker"), F.lit(None).cast("boolean").alias("_more"),
                        F.lit(None).cast("long").alias("_floor")).unionByName(marker)
    stored = store_version(state.coalesce(1), path, batch_id, full)
    for rows in held_rows:
        rows.unpersist()
    return newest(stored.where("NOT _marker").select(*columns), limit)


def _state_schema(found: T.StructType) -> T.StructType:
    return T.StructType([*found.fields]).add("_marker", "boolean").add("_more", "boolean").add("_floor", "long")


def maintained_result(spark: SparkSession, target: str, found: T.StructType, limit: int = SEARCH_ROWS) -> DataFrame | None:
    """The newest rows that a maintained search holds, also when they are none; None before its first batch.

    ``found``: the schema of what the search picks.
    """
    held = latest_version(spark, f"{target}/_state", _state_schema(found))
    return None if held is None else newest(held.where("NOT _marker").select(*found.fieldNames()), limit)


def _facts(rows: DataFrame):
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("floor")).first()


def debounce_events(events: DataFrame, gap_seconds: float = BURST_GAP,
                    parts: int | None = None) -> DataFrame:
    """The last value of each burst: ``events(key, ts, id, value)``.

    A row passes when the next one of its key comes no sooner than the gap, or never;
    empty and zero values pass at once.
    """
    gap = int(round(gap_seconds * 1_000_000))
    placed = with_next(events, ["key"], ["ts", "id"], "ts", "_next", parts)
    quiet = F.col("_next").isNull() | (F.unix_micros("_next") - F.unix_micros("ts") >= gap)
    return placed.where(quiet | F.coalesce(_empty(events), F.lit(False))).select(*events.columns)


def _empty(events: DataFrame):
    if events.schema["value"].dataType.typeName() == "string":
        return F.col("value") == ""
    return F.col("value") == 0


def debounce_stream(events: DataFrame, gap: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """The same on a stream: the last value of each burst, once the watermark has closed it.

    Bursts are session windows; empty and zero values pass at once. A burst that is still
    open when the stream stops comes out after a later event has moved the watermark on.
    """
    last = (events.withWatermark("ts", late)
            .groupBy(F.session_window("ts", gap), "key")
            .agg(F.max_by(F.struct("ts", "id", "value"), F.struct("ts", "id")).alias("last"))
            .select("key", "last.*"))
    at_once = F.coalesce(_empty(events), F.lit(False))
    return last.where(~at_once).unionByName(events.where(at_once).select(*last.columns))


def upload_queue(stream: DataFrame, push: Callable[[DataFrame], DataFrame], target: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Push gathered rows batch by batch; a repeated batch overwrites its own push."""
    def send(batch: DataFrame, batch_id: int) -> None:
        push(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
