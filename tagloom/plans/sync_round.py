"""The synchronisation loop: one round as a plan, rounds tied together by tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.search import dirty_rows
from ..operators.sync import (
    ACCEPTED, KEY, SENT_BACK, ack_clean, apply_reconciled, audit_rows, free_tids, occ_classify,
    occ_relevant, renumber_moved, require_unique, sync_reconcile, with_prev_dt,
)
from ..schema import TAG_COLUMNS
from .shared import latest_version, store_version, through_table

# Fixed value: rounds tried before giving up.
MAX_ROUNDS = 5


@dataclass(frozen=True)
class Facts:
    """What a round must know of the whole server table; its unique keys are checked once."""

    dt: datetime | None
    tid: int | None


FACTS = T.StructType([T.StructField("dt", T.TimestampType()), T.StructField("tid", T.LongType())])


def facts_of(base: DataFrame, check_keys: bool = True) -> Facts:
    """Maxima of a table, by a scan; with ``check_keys`` its (type, ref) must be unique."""
    if check_keys:
        require_unique(base, "server table")
    return Facts(*base.agg(F.max("dt"), F.max("tid")).first())


def write_facts(spark: SparkSession, path: str, version: int, facts: Facts) -> None:
    """Keep the facts of a version of the table beside it."""
    store_version(spark.createDataFrame([(facts.dt, facts.tid)], FACTS).coalesce(1), path, version, FACTS)


def read_facts(spark: SparkSession, path: str) -> Facts | None:
    """The newest version's facts, None where none are kept."""
    held = latest_version(spark, path, FACTS)
    return None if held is None else Facts(*held.first())


@dataclass
class Round:
    base: DataFrame
    local: DataFrame
    audit: DataFrame
    dirty: int
    accepted: int
    downloaded: int
    facts: Facts

    @property
    def settled(self) -> bool:
        return not (self.dirty or self.accepted or self.downloaded)


def sync_once(base: DataFrame, local: DataFrame, now, parts: int | None = None,
              check_keys: bool = True, facts: Facts | None = None) -> Round:
    """One round: classify, accept on the server, clean what was accepted, reconcile.

    Both sides keep one owner for each ``tid``. ``check_keys`` asserts that (type, ref) is
    unique on either side, which the rules rest on. ``facts`` are those of ``base``, as the
    round before or ``read_facts`` gives them; a round keeps keys unique and knows the new
    maxima from what it stores, so with them no scan of the server table looks for either.

    What the round changes is written as tables of its own size: categories, accepted
    rows, put rows and renumbered rows. The next base and local table are the old ones
    with these laid over, as plans; no round rewrites a whole table. The numbers that
    come to the driver are counts and maxima.
    """
    mods = dirty_rows(local)
    server = facts or facts_of(base, check_keys)
    if check_keys:
        require_unique(mods, "dirty rows")
    marks = local.agg(F.max("dt").alias("dt"), F.max("tid").alias("tid")).first()
    classified = through_table(occ_classify(
        occ_relevant(base, mods, marks["dt"]), mods, marks["dt"],
        newest=F.lit(server.dt).cast("timestamp"),
    ).where("category <> 'unchanged'"), "classified")
    accepted = classified.where(F.col("category").isin(*ACCEPTED)).select("mod.*")
    incoming = classified.where(F.col("category").isin(*SENT_BACK)).select("base.*")
    sizes = classified.agg(
        F.count("mod").alias("dirty"),
        F.count_if(F.col("category").isin(*ACCEPTED)).alias("accepted"),
        F.count_if(F.col("category").isin(*SENT_BACK)).alias("downloaded")).first()

    next_base, cleaned = base, local
    top = max(marks["tid"] or 0, server.tid or 0)
    if sizes["accepted"]:
        stored = through_table(
            free_tids(accepted, base, top, parts).withColumn("rec", with_prev_dt(F.col("rec"), F.col("dt")))
            .withColumn("dt", F.lit(now).cast("timestamp"))
            .withColumn("modAt", F.lit(None).cast("timestamp")).select(*TAG_COLUMNS), "stored")
        # The server identifies rows by unique key; an edited row replaces its old version.
        next_base = base.join(stored.select(*KEY), KEY, "left_anti").select(
            *TAG_COLUMNS).unionByName(stored)
        cleaned = ack_clean(local, stored, now)
        new = Facts(*stored.agg(F.max("dt"), F.max("tid")).first())
        top = max(top, new.tid or 0)
        server = Facts(*(max((x for x in pair if x is not None), default=None) for pair in ((server.dt, new.dt), (server.tid, new.tid))))
    if sizes["downloaded"]:
        puts = through_table(sync_reconcile(cleaned, incoming, now), "puts")
        renumbered = through_table(renumber_moved(puts, incoming, top, parts), "renumbered")
        next_local = apply_reconciled(cleaned, incoming, puts, renumbered)
    else:
        # Nothing came back: dirty rows forget their time, so that they count as new.
        next_local = cleaned.withColumn("dt", F.when(F.col("modAt").isNull(), F.col("dt"))).select(
            *TAG_COLUMNS)
        puts = incoming.select(F.lit("server").alias("action"), *TAG_COLUMNS)  # no rows
    return Round(
        base=next_base, local=next_local, audit=audit_rows(incoming, cleaned, puts, now),
        dirty=sizes["dirty"], accepted=sizes["accepted"], downloaded=sizes["downloaded"],
        facts=server,
    )


def sync_until_settled(base: DataFrame, local: DataFrame, times: list, parts: int | None = None,
                       most: int = MAX_ROUNDS, must_settle: bool = False, facts: Facts | None = None) -> tuple[DataFrame, DataFrame, list[Round]]:
    """Rounds until nothing moves; ``times`` are the rounds' clocks, at most ``most`` of them.

    ``rounds[-1].settled`` tells whether the tables have settled; with ``must_settle``
    tables that have not are an error. The two tables are written once, at the end.
    """
    if len(times) > most:
        raise ValueError(f"{len(times)} clocks for at most {most} rounds")
    rounds: list[Round] = []
    for now in times:
        done = sync_once(base, local, now, parts, check_keys=not rounds, facts=facts)
        rounds.append(done)
        base, local, facts = done.base, done.local, done.facts
        if done.settled:
            break
    if must_settle and not (rounds and rounds[-1].settled):
        raise RuntimeError(f"not settled after {len(rounds)} rounds")
    return through_table(base, "base"), through_table(local, "local"), rounds


__all__ = ["Facts", "MAX_ROUNDS", "Round", "facts_of", "read_facts", "sync_once", "sync_until_settled", "write_facts"]
