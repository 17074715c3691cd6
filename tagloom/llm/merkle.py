"""Merkle manifest of a dataset: checkpoints of the trees, proofs by regenerating what lies between.

A row's leaf is the SHA-256 of its fields. The leaves of a language, in order of
``doc_id``, are the lowest level of its tree; ``WIDTH`` consecutive nodes become one. The
languages' roots, in order, are the leaves of the tree above.

Of the levels only every ``STEP``-th is written. Nodes in between belong to one aligned
subtree of ``WIDTH ** STEP`` stored descendants, a group of bounded size, so that building
is a grouping with a bounded row per group, whatever holds most of the rows. Proofs go
down the stored levels: for each subtree the missing nodes are worked out again from its
stored descendants, the siblings of every descendant are emitted behind those of the
subtree's own top, and the nodes are let go.

Texts are read once, where they lie; only digests are shuffled. A proof is an array of
(before, after), a step for each level from the leaf up: the digests of the siblings to
the left and right, each joined. A step without siblings hashes its node alone.

Defined results: null fields hash as ``-``; rows with equal ``doc_id`` (null first) stand
by their leaf; repeated rows have leaves of their own with equal digests; a null language
is a tree of its own, the first; an empty table has no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import ordered
from ..plans.shared import through_table

WIDTH = 8  # nodes that become one
STEP = 3  # levels from one stored level to the next
SPAN = WIDTH ** STEP

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field with its length in bytes, so that fields cannot run into each other."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of ``documents`` that has this text."""
    return F.sha2(F.concat(*(field(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _level_above(digests: Column) -> Column:
    """The nodes above one aligned run of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / WIDTH).cast("int")),
                       lambda k: F.sha2(joined(F.slice(digests, k * WIDTH + 1, F.lit(WIDTH))), 256))


def _height(count: Column) -> Column:
    """Levels above the leaves until one node remains; whole numbers, so without rounding."""
    out = F.lit(0)
    for k in range(20):
        out = out + (count > WIDTH ** k).cast("int")
    return out


@dataclass
class Tree:
    """Trees of all keys. ``levels``: (key, at, digest) of every stored level, with further
    columns on the lowest; ``tops``: (key, height, digest)."""

    levels: list[DataFrame]
    heights: DataFrame
    tops: DataFrame


def _subtrees(nodes: DataFrame, heights: DataFrame, level: int, extra: list[str]) -> DataFrame:
    """The stored nodes of each aligned subtree in order, and how many levels it has here.

    key, part, nodes (at, digest, ...), height, up. Groups of at most ``SPAN`` rows.
    """
    grouped = nodes.groupBy("key", F.floor(F.col("at") / SPAN).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", *extra))).alias("nodes"))
    known = heights.select(F.col("key").alias("of"), "height")
    return grouped.join(known, F.col("key").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "up", F.greatest(F.lit(0), F.least(F.lit(STEP), F.col("height") - level)))


def _with_levels(groups: DataFrame) -> DataFrame:
    """Regenerates the levels of a subtree: l0 from the stored nodes, then up to ``STEP`` more."""
    out = groups.withColumn("l0", F.transform("nodes", lambda x: x["digest"]))
    for k in range(1, STEP + 1):
        below = F.col(f"l{k - 1}")
        out = out.withColumn(f"l{k}", F.when(F.col("up") >= k, _level_above(below)).otherwise(below))
    return out


def build(leaves: DataFrame, extra: list[str] | None = None) -> Tree:
    """Trees over ``leaves``: key, at (from 0 within the key), digest."""
    extra = extra or []
    sizes = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heights = through_table(sizes.select("key", _height(F.col("n")).alias("height")), "heights")
    highest = heights.agg(F.max("height")).first()[0] or 0
    levels, tops, level, nodes = [leaves], None, 0, leaves
    while True:
        groups = _with_levels(_subtrees(nodes.select("key", "at", "digest"), heights, level, [])).select(
            "key", F.col("part").alias("at"), F.element_at(f"l{STEP}", 1).alias("digest"), "height")
        nodes = through_table(groups, "level")
        done = nodes.where(F.col("height") <= level + STEP).select("key", "height", "digest")
        tops = done if tops is None else tops.unionByName(done)
        level += STEP
        if highest <= level:
            return Tree(levels, heights, tops)
        nodes = nodes.where(F.col("height") > level).select("key", "at", "digest")
        levels.append(nodes)


def proofs(tree: Tree, above: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """key, at, digest, further columns and steps of every leaf.

    ``above``: key and the steps that follow its top, with columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("key", "steps")]
    below = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level, own = k * STEP, (extra or []) if k == 0 else []
        ends = above.join(tree.heights.select(F.col("key").alias("of"), "height"), F.col("key").eqNullSafe(F.col("of"))).where(
            (F.col("height") <= level + STEP) & (F.col("height") > (level if k else -1))).select(
            "key", F.lit(0).cast("long").alias("part"), "steps", *handed)
        upper = ends if below is None else ends.unionByName(below.select("key", F.col("at").alias("part"), "steps", *handed))
        upper = upper.withColumnsRenamed({"key": "of", "part": "top"})
        groups = _with_levels(_subtrees(tree.levels[k], tree.heights, level, own))
        met = groups.join(upper, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("top")))
        node = met.select("key", *handed, "steps", "up", *(f"l{j}" for j in range(STEP)), F.posexplode("nodes").alias("i", "x"))
        found = node.select("key", *handed, *(F.col(f"x.{c}").alias(c) for c in ("at", "digest", *own)), _steps().alias("steps"))
        below = through_table(found, "proofs") if k else found
    return below


def _steps() -> Column:
    """Siblings of node ``i`` of a subtree on each of its levels, then the steps of its top."""
    own = []
    for j in range(STEP):
        at = F.floor(F.col("i") / WIDTH ** j).cast("int")
        first = at - at % WIDTH
        own.append(F.when(F.col("up") > j, F.struct(
            joined(F.slice(F.col(f"l{j}"), first + 1, at - first)).alias("before"),
            joined(F.slice(F.col(f"l{j}"), at + 2, F.lit(WIDTH - 1) - (at - first))).alias("after"))))
    return F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()).cast(STEPS), F.col("steps"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and steps of every row, and the leaf of the ``tampered`` text."""
    own = leaf(F.col("text"))
    rows = docs.select(
        F.col("lang").cast("string").alias("key"), F.col("doc_id").alias("doc_id"), own.alias("digest"),
        (own if tampered is None else leaf(tampered)).alias("seen"), F.lit(1).cast("long").alias("at"),
        F.monotonically_increasing_id().alias("row"))
    placed = ordered.running(rows, ["key"], ["doc_id", "digest", "row"], {"at": ordered.SUM})
    leaves = through_table(placed.select("key", F.expr("at - 1").alias("at"), "digest", "doc_id", "seen"), "leaves")
    trees = build(leaves)
    langs = ordered.with_position(trees.tops.select(F.col("key").alias("lang"), "digest"), ["lang"], "at")
    langs = through_table(langs.select(F.lit(0).alias("key"), "at", "digest", "lang"), "languages")
    top = build(langs)
    root = top.tops.select(F.col("key"), F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))
    subroots = proofs(top, root, ["lang"]).select(F.col("lang").alias("key"), F.col("digest").alias("subroot"), "root", "steps")
    return proofs(trees, through_table(subroots, "subroots"), ["doc_id", "seen"]).select(
        "doc_id", F.col("key").alias("lang"), F.col("digest").alias("leaf"), "seen", "subroot", "root", "steps")


def proof_digest(steps: Column) -> Column:
    return F.sha2(joined(F.transform(steps, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verify(found: DataFrame) -> DataFrame:
    """Folds the seen leaf of every row of ``manifest`` along its proof."""
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.col("seen"), F.col("steps")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
