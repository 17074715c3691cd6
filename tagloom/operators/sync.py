"""Optimistic synchronisation: classify edits, reconcile keys, merge rows.

Rows of the server table (``base``) and dirty local rows meet on the unique key
(type, ref), which is unique on each side. Every operator is a join of whole tables;
the loop over rounds is in ``plans.sync_round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import let
from ..functions.merge import merge3_tags, merge3_text, rec_merge
from ..schema import TAG_COLUMNS, TAGS, tag_struct
from .tables import reassign_pk, upsert

KEY = ["type", "ref"]
# Fixed value: how deep records are merged.
MERGE_DEPTH = 3
# What the sync rules read from a row's record.
ORIGIN = "struct<b4mod: struct<dt: timestamp, txt: string, sts: array<string>>, prev_dt: timestamp>"

ACCEPTED = ("ins", "upd")
SENT_BACK = ("toMerge", "newer")


def require_unique(df: DataFrame, what: str) -> DataFrame:
    """Raise unless (type, ref) is unique; the price is one aggregation of the keys."""
    twice = df.groupBy(*KEY).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{what}: (type, ref) is not unique, for example {twice[0].asDict()}")
    return df


def occ_relevant(base: DataFrame, mods: DataFrame, last_dt) -> DataFrame:
    """The server rows a round can touch: changed since ``last_dt``, or sent as edited.

    The first part is a filter that reaches the scan. The second is a semi join with
    the edited keys, which are few, so the server's rows are not shuffled for it.
    """
    if last_dt is None:
        return base
    changed = F.col("dt") > F.lit(last_dt).cast("timestamp")
    sent = base.where(~changed | F.col("dt").isNull()).join(mods.select(*KEY), KEY, "left_semi")
    return base.where(changed).unionByName(sent.select(*base.columns))


def occ_classify(base: DataFrame, mods: DataFrame, last_dt, newest: Column | None = None) -> DataFrame:
    """Category of every key: (type, ref, category, mod, base), the rows as structs.

    ins / blocked: the server lacks the key, and the client is / is not up to date;
    upd / toMerge: it has it, at the same / another time; newer: not sent, and changed
    since ``last_dt``; unchanged: not sent, not changed. ``last_dt`` is a time or null.
    ``newest`` is the server's latest time, needed when ``base`` is only a part of it.
    """
    newest = base.select(F.max("dt")).scalar() if newest is None else newest
    seen = last_dt if isinstance(last_dt, Column) else F.lit(last_dt).cast("timestamp")
    up_to_date = F.coalesce(seen == newest, newest.isNull())
    joined = (
        base.select(*KEY, tag_struct().alias("base")).join(
            mods.select(*KEY, tag_struct().alias("mod")), KEY, "full_outer"))
    category = (
        F.when(F.col("base").isNull(), F.when(up_to_date, "ins").otherwise("blocked"))
        .when(F.col("mod").isNotNull(),
              F.when(F.col("mod.dt") == F.col("base.dt"), "upd").otherwise("toMerge"))
        .when(seen.isNull() | (F.col("base.dt") > seen), "newer")
        .otherwise("unchanged"))
    return joined.withColumn("category", category).select(*KEY, "category", "mod", "base")


def ack_clean(local: DataFrame, acked: DataFrame, server_now) -> DataFrame:
    """Dirty rows whose key was accepted become clean and take the server's time, and its tid if it has one."""
    now = F.lit(server_now).cast("timestamp")
    hit = F.col("_ok").isNotNull()
    given = F.max("tid") if "tid" in acked.columns else F.max(F.lit(None).cast("bigint"))
    # Only dirty rows can be accepted; the clean ones take no part in the join.
    dirty = (
        local.where("modAt is not null")
        .join(acked.groupBy(*KEY).agg(given.alias("_tid")).withColumn("_ok", F.lit(True)), KEY, "left")
        .withColumn("tid", F.coalesce("_tid", "tid"))
        .withColumn("dt", F.when(hit, now).otherwise(F.col("dt")))
        .withColumn("modAt", F.when(~hit, F.col("modAt")))
        .select(*local.columns))
    return local.where("modAt is null").unionByName(dirty)


def _struct_with(row: Column, **changed: Column) -> Column:
    """A struct of tag columns with some of them replaced."""
    return F.struct(*[changed.get(c, row[c]).cast(TAGS[c].dataType).alias(c) for c in TAG_COLUMNS])


def merge_row(mine: Column, theirs: Column, now: Column) -> Column:
    """Merge a locally edited row with the server's; both are structs of tag columns.

    When my row carries the copy it was edited from, and that copy's time is the
    server's previous time, my edit is applied to the server's row, the records are
    merged and the row stays dirty. Otherwise my row stays and takes the server's time.
    """
    origin = F.from_json(mine["rec"], ORIGIN)["b4mod"]
    same_origin = F.coalesce(
        origin["dt"] == F.from_json(theirs["rec"], ORIGIN)["prev_dt"], F.lit(False))
    # Texts are merged outside of any lambda, and only those that the row below takes.
    txt = merge3_text(*(F.when(same_origin, x) for x in (origin["txt"], mine["txt"], theirs["txt"])))
    patched = _struct_with(
        theirs, modAt=now, txt=txt,
        sts=merge3_tags(origin["sts"], mine["sts"], theirs["sts"]),
        rec=rec_merge(mine["rec"], theirs["rec"], MERGE_DEPTH))
    return F.when(same_origin, patched).otherwise(_struct_with(mine, dt=theirs["dt"]))


def with_prev_dt(rec: Column, prev_dt: Column) -> Column:
    """The record with the field ``prev_dt`` set."""
    stamp = F.to_json(F.struct(F.date_format(prev_dt, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("prev_dt")))
    return F.when(prev_dt.isNull(), rec).otherwise(rec_merge(rec, stamp, 1))


def free_tids(accepted: DataFrame, base: DataFrame, above: int, parts: int | None = None) -> DataFrame:
    """Accepted rows as the server may store them: no ``tid`` that another key has.

    A row whose ``tid`` belongs to another key of ``base``, or is claimed by several
    accepted rows (the smallest key keeps it), gets a fresh one above ``above``.
    """
    keyed = accepted.where("tid IS NOT NULL").select("tid", F.struct(*KEY).alias("k"))
    held = base.where("tid IS NOT NULL").join(keyed.select("tid").distinct(), "tid", "left_semi").select("tid", F.struct(*KEY).alias("k"))
    first = keyed.groupBy("tid").agg(F.min("k").alias("first"))
    other = keyed.join(held.withColumnRenamed("k", "of"), "tid").where("k <> of").select("tid", "k")
    late = keyed.join(first, "tid").where("k <> first").select("tid", "k")
    taken = other.union(late).distinct().select("k.*")
    moved = accepted.join(taken, KEY, "left_semi")
    return accepted.join(taken, KEY, "left_anti").select(*TAG_COLUMNS).unionByName(
        reassign_pk(moved.select(*TAG_COLUMNS), KEY, above, parts))


def sync_reconcile(local: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Rows to put for the server rows in ``incoming``, each with an ``action``.

    server: the server's row, clean. merged: my dirty row with the same unique key,
    merged with it; it takes the server's key. moved: a local row of another unique key
    that held the server row's ``tid``; it loses the key and becomes dirty. split: of
    several server rows on one ``tid`` the newest keeps it; the others lose it and become
    dirty, so that the server learns their fresh keys.
    """
    stamp = F.lit(now).cast("timestamp")
    owner = F.struct("dt", *KEY)
    owners = incoming.where("tid IS NOT NULL").groupBy("tid").agg(F.max(owner).alias("owner"))
    dirty = local.where("modAt is not null").select(*KEY, tag_struct().alias("mine"))
    # Reduced by a semi join first: the incoming keys are few, the local rows many.
    holders = (local.where("tid is not null")
               .join(incoming.select("tid").distinct(), "tid", "left_semi")
               .select("tid", tag_struct().alias("holder")))
    rows = incoming.select(*KEY, "tid", tag_struct().alias("theirs"), owner.alias("own")).join(dirty, KEY, "left")
    # Rows without a tid meet no holder; they go around the joins instead of into one task.
    keyless = rows.where("tid IS NULL").withColumns({
        "owner": F.col("own"), "holder": F.lit(None).cast(holders.schema["holder"].dataType)})
    joined = rows.where("tid IS NOT NULL").join(owners, "tid").join(holders, "tid", "left").unionByName(keyless)
    theirs, mine, holder = F.col("theirs"), F.col("mine"), F.col("holder")
    joined = joined.withColumn("both", merge_row(mine, theirs, stamp))
    merged = _struct_with(F.col("both"), tid=F.coalesce(theirs["tid"], F.col("both.tid")))
    put = F.when(mine.isNotNull(), merged).otherwise(_struct_with(theirs, modAt=F.lit(None)))
    other = holder.isNotNull() & ~(
        (holder["type"] == theirs["type"]) & (holder["ref"] == theirs["ref"]))
    moved = _struct_with(holder, tid=F.lit(None), modAt=stamp)
    owns = F.col("own").eqNullSafe(F.col("owner"))
    row = let(put, lambda p: F.when(owns, p).otherwise(_struct_with(p, tid=F.lit(None), modAt=stamp)))
    outputs = F.array(
        F.struct(F.when(~owns, "split").when(mine.isNotNull(), "merged").otherwise("server").alias("action"), row.alias("row")),
        F.when(other & owns, F.struct(F.lit("moved").alias("action"), moved.alias("row"))))
    return (joined.select(F.inline(F.filter(outputs, lambda o: o.isNotNull())))
            .select("action", "row.*"))


def renumber_moved(puts: DataFrame, incoming: DataFrame, above: int,
                   parts: int | None = None) -> DataFrame:
    """Moved and split rows with new keys above ``above``, the largest key in use anywhere.

    A moved row is left out when the server sent its unique key too: that key's own
    put row already stands for it.
    """
    moved = puts.where("action = 'moved'").drop("action")
    orphans = moved.join(incoming.select(*KEY).distinct(), KEY, "left_anti").select(*TAG_COLUMNS).dropDuplicates(KEY)
    split = puts.where("action = 'split'").select(*TAG_COLUMNS)
    return reassign_pk(orphans.unionByName(split), KEY, above, parts)


def apply_reconciled(local: DataFrame, incoming: DataFrame, puts: DataFrame,
                     renumbered: DataFrame) -> DataFrame:
    """The next local table: put and renumbered rows in, what they replace out."""
    settled = puts.where("action NOT IN ('moved', 'split')").drop("action")
    server_keys = incoming.select(*KEY).distinct()
    keyless = local.where("tid is null")
    untouched = (
        local.where("tid is not null")
        .join(incoming.select("tid").where("tid is not null").distinct(), "tid", "left_anti")
        .select(*TAG_COLUMNS).unionByName(keyless.select(*TAG_COLUMNS))
        .join(server_keys, KEY, "left_anti").select(*TAG_COLUMNS))
    return (settled.select(*TAG_COLUMNS)
            .unionByName(renumbered)
            .unionByName(untouched))


def bulk_merge(live: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Overlay incoming rows on live rows with the same ``tid``, each with an ``action``.

    merged: same unique key, the two are merged. placed: another one, the incoming row takes
    the place. displaced: the live row it took it from, without key, to be numbered anew.
    split: of several incoming rows on one ``tid`` the newest owns it; the others come
    without key too, once each. All become dirty. Live rows that no incoming row meets are
    not part of the result.
    """
    stamp = F.lit(now).cast("timestamp")
    claims = incoming.where("tid IS NOT NULL").select("tid", tag_struct().alias("inc")).distinct()
    owners = claims.groupBy("tid").agg(F.max(F.struct("inc.dt", "inc.type", "inc.ref", "inc")).alias("owner"))
    joined = (live.where("tid is not null").select("tid", tag_struct().alias("live"))
              .join(claims, "tid").join(owners.select("tid", F.col("owner.inc").alias("owner")), "tid"))
    joined = joined.withColumn("owns", F.col("inc").eqNullSafe(F.col("owner")))
    inc, old, owns = F.col("inc"), F.col("live"), F.col("owns")
    same = (inc["type"] == old["type"]) & (inc["ref"] == old["ref"])
    joined = joined.withColumn("both", merge_row(inc, old, stamp))
    placed = _struct_with(F.when(same, F.col("both")).otherwise(inc), modAt=stamp)
    keyless = lambda row: _struct_with(row, tid=F.lit(None), modAt=stamp)
    outputs = F.array(
        F.when(owns, F.struct(F.when(same, "merged").otherwise("placed").alias("action"), placed.alias("row"))),
        F.when(owns & ~same, F.struct(F.lit("displaced").alias("action"), keyless(old).alias("row"))),
        F.when(~owns, F.struct(F.lit("split").alias("action"), keyless(inc).alias("row"))))
    return (joined.select(F.inline(F.filter(outputs, lambda o: o.isNotNull())))
            .select("action", "row.*"))


def apply_bulk_merge(live: DataFrame, merged: DataFrame, above: int,
                     parts: int | None = None) -> DataFrame:
    """The next table after ``bulk_merge``: displaced and split rows get new keys above ``above``."""
    placed = merged.where("action IN ('merged', 'placed')").select(*TAG_COLUMNS)
    displaced = merged.where("action IN ('displaced', 'split')").select(*TAG_COLUMNS)
    return upsert(live.select(*TAG_COLUMNS), placed).unionByName(
        reassign_pk(displaced, KEY, above, parts))


def audit_rows(incoming: DataFrame, local: DataFrame, puts: DataFrame, now) -> DataFrame:
    """What a reconciliation read and wrote: (key, action, at, row as JSON)."""
    at = F.lit(now).cast("timestamp")

    def log(rows: DataFrame, action: Column) -> DataFrame:
        return rows.select(
            F.struct(*KEY).alias("key"), action.alias("action"), at.alias("at"),
            F.to_json(F.struct(*TAG_COLUMNS)).alias("row"))

    dirty = local.where("modAt is not null").join(incoming.select(*KEY).distinct(), KEY, "left_semi")
    held = (local.where("tid is not null")
            .join(incoming.select("tid").distinct(), "tid", "left_semi"))
    return (log(dirty, F.lit("edited")).unionByName(log(held, F.lit("local")))
            .unionByName(log(puts, F.col("action"))))
