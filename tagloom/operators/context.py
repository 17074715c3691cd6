"""Rows around a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import with_position
from .search import pk_above, pk_below

# Fixed value: size of the window the list opens.
AROUND_ROWS = 33


def _sides(n: int) -> tuple[int, int]:
    n = max(3, n)
    below = n // 2
    return below, n - below - 1


def rows_around(tags: DataFrame, tid: int, n: int = AROUND_ROWS) -> DataFrame:
    """The row with this key and its neighbours, n in all, largest key first."""
    below, above = _sides(n)
    return (pk_above(tags, tid, above)
            .unionByName(tags.where(F.col("tid") == tid))
            .unionByName(pk_below(tags, tid, below))
            .orderBy(F.desc("tid")))


def rows_around_each(tags: DataFrame, anchors: DataFrame, n: int = AROUND_ROWS,
                     parts: int | None = None) -> DataFrame:
    """Windows around many keys at once: ``anchors(tid)`` -> (anchor, tid).

    Keys are numbered densely, so a window is a run of places and the lookup an
    equality join; a key missing from the table opens no window.
    """
    below, above = _sides(n)
    placed = with_position(tags.select("tid").where("tid is not null"), ["tid"], parts=parts)
    wanted = (
        anchors.select("tid").distinct().join(placed, "tid")
        .select(F.col("tid").alias("anchor"),
                F.explode(F.sequence(F.col("pos") - below, F.col("pos") + above)).alias("pos"))
    )
    return wanted.join(placed, "pos").select("anchor", "tid")
