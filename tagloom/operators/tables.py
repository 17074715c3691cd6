"""Upserts, patches, deletes and other whole-table changes, as new versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.ordered import with_position


def _keyed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a key. The latter match nothing, so they skip the join
    instead of all meeting in the one task that null keys hash to."""
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())


def last_per_key(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: the last along ``order``, else along all columns as they stand.

    Combined before the shuffle, so a key that comes very often stays cheap.
    """
    order = order or [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)) if order else F.max(F.struct(*rows.columns))
    return rows.groupBy(F.col(key).alias("_last")).agg(best.alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "tid", order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those with the same key, and are added otherwise.

    Of several new rows with one key the last along ``order`` is put; without ``order``,
    the largest. Rows without a key are always added.
    """
    keyed, keyless = _keyed(old, key)
    fresh, added = _keyed(new, key)
    put = last_per_key(fresh, key, order).select(*old.columns)
    return keyed.join(fresh.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(
        keyless).unionByName(put).unionByName(added.select(*old.columns))


def bulk_update(old: DataFrame, changes: DataFrame, key: str = "tid", order: list[str] | None = None) -> DataFrame:
    """Patch the columns that ``changes`` has, where it states a value.

    Of several changes of one key the last along ``order`` counts, as in ``upsert``.
    """
    keyed, keyless = _keyed(old, key)
    changes = last_per_key(changes.where(F.col(key).isNotNull()), key, order)
    patched = [c for c in changes.columns if c != key]
    joined = keyed.alias("o").join(changes.alias("c"), key, "left")
    return joined.select([
        F.coalesce(f"c.{c}", f"o.{c}").alias(c) if c in patched
        else (F.col(key) if c == key else F.col(f"o.{c}"))
        for c in old.columns
    ]).unionByName(keyless)


def delete_by_key(old: DataFrame, keys: DataFrame, key: str = "tid") -> DataFrame:
    keyed, keyless = _keyed(old, key)
    gone = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return keyed.join(gone, key, "left_anti").select(*old.columns).unionByName(keyless)


def fill_missing_dt(tags: DataFrame, now) -> DataFrame:
    """Rows without a time get ``now``; ``fixed`` tells which."""
    return tags.withColumn("fixed", F.col("dt").isNull()).withColumn(
        "dt", F.coalesce("dt", F.lit(now).cast("timestamp")))


def audit_columns(old: DataFrame, new: DataFrame, now, key: str = "key") -> DataFrame:
    """Upsert that stamps rows: addAt and modAt when created, modAt when updated."""
    stamp = F.lit(now).cast("timestamp")
    payload = [c for c in new.columns if c != key]
    # Marks rows that come in, even those whose other columns are all null.
    incoming = new.withColumn("_in", F.lit(True))
    comes_in = F.col("n._in").isNotNull()
    return old.alias("o").join(incoming.alias("n"), key, "full_outer").select(
        key,
        *[F.when(comes_in, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload],
        F.coalesce("o.addAt", stamp).alias("addAt"),
        F.when(comes_in, stamp).otherwise(F.col("o.modAt")).alias("modAt"))


def union_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def except_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; copies in ``left`` all stay."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def intersect_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def insert_if_absent(tags: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose (ref, type) the table lacks, each pair once.

    The table's side is reduced to distinct pairs first, so a pair that fills a third
    of the table reaches the join as one row.
    """
    one = (candidates.groupBy("ref", "type").agg(F.min(F.struct(*candidates.columns)).alias("c"))
           .select("c.*"))
    return one.join(tags.select("ref", "type").distinct(), ["ref", "type"], "left_anti").select(
        *candidates.columns)


def tag_rows(names: DataFrame, now) -> DataFrame:
    """Rows that define the tags in ``names(name)``."""
    return names.select(
        F.lit(None).cast("bigint").alias("tid"), F.concat("name", F.lit(": ")).alias("txt"),
        F.col("name").alias("ref"), F.array("name").alias("sts"),
        F.lit(now).cast("timestamp").alias("dt"), F.lit("tag").alias("type"),
        F.lit(None).cast("timestamp").alias("modAt"), F.lit(None).cast("string").alias("rec"))


def last_per_prefix(df: DataFrame, prefix: list[str], rest: list[str],
                    wanted: DataFrame | None = None) -> DataFrame:
    """The last row, along ``rest``, of each key prefix; only of ``wanted`` ones if given."""
    if wanted is not None:
        df = df.join(wanted.select(*prefix).distinct(), prefix, "left_semi")
    rank = F.row_number().over(
        Window.partitionBy(*prefix).orderBy(*[F.desc(c) for c in rest]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def reassign_pk(rows: DataFrame, order: list[str], above: int, parts: int | None = None) -> DataFrame:
    """Give rows the keys ``above + 1, above + 2, ...`` along ``order``."""
    return with_position(rows.drop("tid"), order, "tid", above + 1, parts).select(*rows.columns)
