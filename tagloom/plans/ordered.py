"""Ordered scans that never put a whole group, or the whole table, into one task.

A window over a key runs each key in one task, and a window without a key runs
everything in one. Here the rows are stored once, then cut into ranges along
``(key, order)`` by Spark's range partitioning and stored with the number of their
range, the chunk. How many chunks there are follows from the rows alone, and a chunk is
part of the stored row, so a recomputed task finds each row where it was. Windows then run
inside (key, chunk); what one chunk hands to the next is worked out on a summary with a
row per key and chunk, of which only keys that span chunks are joined back. With a unique
last order column even a key that holds a third of all rows, at one point in time, is
split evenly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import through_table

ROWS_PER_CHUNK = 65_536
# Beyond this many chunks they grow instead, so that a shuffle has no more parts than this.
MOST_CHUNKS = 16_384


def chunked(df: DataFrame, columns: list[str], parts: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with its ``_chunk`` along ``columns``, and whether there are several.

    The input is computed once, for the stored copy; its rows are counted there.
    """
    stored = through_table(df, "ordered")
    parts = parts or max(1, min(MOST_CHUNKS, math.ceil(stored.count() / ROWS_PER_CHUNK)))
    if parts == 1:
        return stored.withColumn("_chunk", F.lit(0)), False
    ranged = stored.repartitionByRange(parts, *columns).withColumn("_chunk", F.spark_partition_id())
    return through_table(ranged, "chunks"), True


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _with_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Bring each chunk what the chunks before or after it hand over; few rows have any."""
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_chunk"])}
    right = carry.withColumnsRenamed(names)
    return local.join(right, _same(list(names), list(names.values())), "left").drop(*names.values(), "_chunk")


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, order: list[str], name: str = "pos", start: int = 0,
                  parts: int | None = None) -> DataFrame:
    """Add a dense number along ``order``, counting from ``start``.

    ``order`` must be a total order. Pass a narrow table: all its columns are stored. One
    task adds up the chunks' counts, a row for every ``ROWS_PER_CHUNK`` rows.
    """
    rows, several = chunked(df, order, parts)
    in_chunk = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    numbered = rows.withColumn(name, F.lit(start).cast("bigint") + in_chunk - 1)
    if not several:
        return numbered.drop("_chunk")
    counts = rows.groupBy("_chunk").count()
    offsets = counts.select("_chunk", F.sum("count").over(_before([])).alias("_offset")).where("_offset > 0")
    return _with_carry(numbered, offsets, []).withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str,
                name: str = "running_max", parts: int | None = None) -> DataFrame:
    """Add the largest ``value`` so far within ``keys`` along ``order``."""
    rows, several = chunked(df, keys + order, parts)
    local = rows.withColumn(name, F.max(value).over(
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not several:
        return local.drop("_chunk")
    tops = rows.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    carry = tops.withColumn("_earlier", F.max("_top").over(_before(keys))).drop("_top").where("_earlier IS NOT NULL")
    return _with_carry(local, carry, keys).withColumn(name, F.greatest(F.col(name), F.col("_earlier"))).drop("_earlier")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str,
                name: str = "before", parts: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows within ``keys`` along ``order``."""
    rows, several = chunked(df, keys + order, parts)
    zero = F.lit(0).cast("bigint")
    local = rows.withColumn(name, F.coalesce(F.sum(value).over(
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), zero))
    if not several:
        return local.drop("_chunk")
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    carry = sums.withColumn("_earlier", F.sum("_sum").over(_before(keys))).drop("_sum").where("_earlier IS NOT NULL")
    return _with_carry(local, carry, keys).withColumn(name, F.col(name) + F.coalesce("_earlier", zero)).drop("_earlier")


# Aggregates that `running` can carry from chunk to chunk: the aggregate, and how two of them add up.
SUM = (F.sum, lambda a, b: a + b)
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple],
            parts: int | None = None) -> DataFrame:
    """Replace each column of ``values`` by its aggregate over this row and all earlier ones
    within ``keys`` along ``order``. Values are not null."""
    rows, several = chunked(df, keys + order, parts)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({name: of(name).over(within) for name, (of, _) in values.items()})
    if not several:
        return local.drop("_chunk")
    tops = rows.groupBy(*keys, "_chunk").agg(*(of(name).alias(name) for name, (of, _) in values.items()))
    carry = tops.select(*keys, "_chunk", *(of(name).over(_before(keys)).alias(f"_{name}") for name, (of, _) in values.items()))
    found = _with_carry(local, carry.where(F.col(f"_{next(iter(values))}").isNotNull()), keys)
    return found.withColumns({
        name: F.coalesce(plus(F.col(name), F.col(f"_{name}")), F.col(name)) for name, (_, plus) in values.items()
    }).drop(*(f"_{name}" for name in values))


def with_next(df: DataFrame, keys: list[str], order: list[str], value: str,
              name: str = "next", parts: int | None = None) -> DataFrame:
    """Add the ``value`` of the following row within ``keys`` along ``order``."""
    rows, several = chunked(df, keys + order, parts)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = rows.withColumn(name, F.lead(value).over(within))
    if not several:
        return local.drop("_chunk")
    # The last row of a chunk looks at the next one; a null value there is a value too.
    local = local.withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
    firsts = rows.groupBy(*keys, "_chunk").agg(F.min_by(F.struct(value), F.struct(*order)).alias("_first"))
    carry = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_first")
    return _with_carry(local, carry.where("_after IS NOT NULL"), keys).withColumn(
        name, F.when(F.col("_last"), F.col(f"_after.{value}")).otherwise(F.col(name))).drop("_after", "_last")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str,
                   alpha: float = 0.5, name: str = "ema", parts: int | None = None) -> DataFrame:
    """Exponential moving average after the last row of each key, seeded by its first.

    Within a chunk the average is a weighted sum whose weights depend on how many rows
    follow, so chunks are summed on their own and then put together with the weight
    ``(1 - alpha) ** rows that follow``.
    """
    rows, _ = chunked(df, keys + order, parts)
    within = Window.partitionBy(*keys, "_chunk")
    place = F.row_number().over(within.orderBy(*order))
    weighed = (
        rows.withColumn("_behind", F.count(F.lit(1)).over(within) - place)
        .withColumn("_part", F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("_behind")) * F.col(value))
    )
    summed = weighed.groupBy(*keys, "_chunk").agg(
        F.sum("_part").alias("_part"), F.count(F.lit(1)).alias("_rows"),
        F.min_by(F.col(value), F.struct(*order)).alias("_first"))
    behind = F.coalesce(F.sum("_rows").over(
        Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        summed.withColumn("_behind", behind)
        .groupBy(*keys)
        .agg((F.sum(F.col("_part") * F.pow(F.lit(1 - alpha), F.col("_behind")))
              + F.min_by("_first", "_chunk") * F.pow(F.lit(1 - alpha), F.sum("_rows"))).alias(name),
             F.sum("_rows").alias("n"))
    )
