"""Prefix trie of conversations, with a count-min screen before the shuffle.

Conversations are rebuilt from the first turns of the head of their hundred and their own
turns. A node of the trie is a distinct sequence of first turns; it is known by a digest
of 120 bits, the exclusive or of digests of (place, role, text), which runs along a
conversation in chunks however long it is. Texts are read once and never shuffled.

Most prefixes belong to one conversation. A count-min sketch over all prefix digests is
counted where the digests lie: two rows of cells, one per half of the digest, whose
counters stop at two, as all that is asked is "one or more". An estimate is never too low,
so an estimate of one proves that the prefix has no other conversation; then all longer
prefixes have none, and their nodes are written where they lie. Only the prefixes that may
be shared are shuffled, to be grouped exactly. The sketch has four cells a prefix, at most
``CELLS`` a row (16 MB as bits): beyond that many prefixes it proves fewer of them alone,
more are shuffled, and the result is the same.

Sums over subtrees need no walk. Of the conversations in a node the smallest id speaks for
it; a conversation that speaks for a node speaks for all deeper ones on its path. So what a
node adds to its ancestors is put down once, at its speaker, summed from the end of that
conversation up, and each node adds up its members.

Defined results: rows without ``conv_id`` take no part; a null role or text is the empty
text; turns with the same number (null first) stand by role, then by the SHA-256 of role
and text, repeated rows as often as they come; an empty table has no node; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans import ordered
from ..plans.shared import through_table
from .common import map_arrow, ship

CELLS = 1 << 26  # of a row of the sketch at most, a power of two
BLOCK = 1 << 16  # cells that travel together
HALF = 15  # hexadecimal digits of half a digest
GROUP, HEADS = 100, 6

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def _halves(text: Column) -> list[Column]:
    """Two numbers of 60 bits from the SHA-256 of a text."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + k * HALF, HALF), 16, 10).cast("long").alias(name) for k, name in enumerate("ab")]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), told (digest of role and text), size (code points) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), told.alias("told"),
        F.char_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("at"), F.monotonically_increasing_id().alias("row"))
    return ordered.running(rows, ["conv_id"], ["turn", "role", "told", "row"], {"at": ordered.SUM}).select(
        "conv_id", "at", "told", "size")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, told, size, length), and conversations (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % 100, h being
    crc32 of c modulo 6, and goes on with its own turns after its first h.
    """
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < HEADS)).groupBy(F.col("conv_id").alias("head")).agg(
        F.array_sort(F.collect_list(F.struct("at", "told", "size"))).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    convs = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head", "left").select(
        "conv_id", "own", h.alias("h"), F.when(h > 0, F.slice("first", 1, h)).alias("first"))
    convs = through_table(convs.withColumn("k", F.coalesce(F.array_size("first"), F.lit(0))).select(
        "conv_id", "h", "k", "first", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    begun = convs.select("conv_id", F.explode("first").alias("x"), "length").select(
        "conv_id", F.col("x.at").alias("depth"), "x.told", "x.size", "length")
    rest = turns.join(convs.drop("first"), "conv_id").where("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "told", "size", "length")
    return begun.unionByName(rest), convs.select("conv_id", "length")


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, size, last, digest (a, b) and the parent's digest (pa, pb) of every prefix."""
    own = _halves(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("told")))
    salted = rebuilt.select("conv_id", "depth", "size", (F.col("depth") == F.col("length")).alias("last"), *own)
    salted = salted.withColumns({"pa": F.col("a"), "pb": F.col("b")})
    run = ordered.running(salted, ["conv_id"], ["depth"], {"a": ordered.XOR, "b": ordered.XOR})
    return run.withColumns({"pa": F.col("pa").bitwiseXOR(F.col("a")), "pb": F.col("pb").bitwiseXOR(F.col("b"))})


class Sketch:
    """Which cells have two or more prefixes, as bits; a row of cells for each half of a digest."""

    def __init__(self, width: int):
        self.width, self.name = width, uuid.uuid4().hex
        self.bits = np.zeros((2, width // 8), np.uint8)

    def possibly_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the estimate of a digest's conversations is above one."""
        out = np.ones(len(a), bool)
        for bits, x in zip(self.bits, (a, b)):
            cell = x & (self.width - 1)
            out &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def sketch_of(prefixes: DataFrame, total: int, most: int = CELLS) -> Sketch:
    """Count-min sketch of the digests (a, b); each task counts its rows, blocks of cells are added up."""
    width = BLOCK // 2
    while width < min(most, 4 * total):
        width *= 2
    sketch = Sketch(width)

    def count(batches):
        cells = np.zeros(2 * width, np.uint8)
        for batch in batches:
            for k, name in enumerate("ab"):
                found, times = np.unique((batch.column(name).to_numpy() & (width - 1)) + k * width, return_counts=True)
                cells[found] = np.minimum(cells[found] + np.minimum(times, 2).astype(np.uint8), 2)
        blocks = cells.reshape(-1, BLOCK)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], ["block", "cells"])

    def add(batches):
        # Rows come sorted by block: counters of one block are held at a time.
        at, held_cells = None, None
        for batch in batches:
            for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                if k != at:
                    if at is not None:
                        yield told(at, held_cells)
                    at, held_cells = k, np.zeros(BLOCK, np.uint8)
                held_cells = np.minimum(held_cells + np.frombuffer(cells, np.uint8), 2)
        if at is not None:
            yield told(at, held_cells)

    def told(k, cells):
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([np.packbits(cells > 1).tobytes()], pa.binary())], ["block", "bits"])

    ship(prefixes.sparkSession)
    counted = prefixes.select("a", "b").mapInArrow(count, "block int, cells binary")
    crowded = counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    flat = sketch.bits.reshape(-1, BLOCK // 8)
    for row in crowded.toLocalIterator():  # 2 * width bits in all
        flat[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return sketch


def screened(prefixes: DataFrame, sketch: Sketch) -> DataFrame:
    """``prefixes`` with ``maybe`` and ``pmaybe``: may it, may its parent, have several conversations."""
    spark = prefixes.sparkSession
    sent = spark.sparkContext.broadcast(sketch)

    def make():
        own = sent.value

        def run(batch: pa.RecordBatch):
            a, b, up_a, up_b = (batch.column(c).to_numpy() for c in ("a", "b", "pa", "pb"))
            root = (up_a == 0) & (up_b == 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.possibly_shared(a, b)), pa.array(root | own.possibly_shared(up_a, up_b))],
                [*batch.schema.names, "maybe", "pmaybe"])
        return run

    return map_arrow(prefixes, make, prefixes.withColumns({"maybe": F.lit(True), "pmaybe": F.lit(True)}).schema)


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the ids (conv_id) of every digest in order, comma-joined and hashed.

    Ids are joined inside chunks of bounded size; the chunks of one digest then stream
    through one hash, which the contract makes a chain.
    """
    chunks, _ = ordered.chunked(ends.select("a", "b", "conv_id"), ["a", "b", "conv_id"])
    joined = chunks.groupBy("a", "b", "_chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        at, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c) for c in ("a", "b", "ids"))):
                key, text = (a.as_py(), b.as_py()), ids.as_py().encode()
                if key == at:
                    digest.update(b"," + text)
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(text)
            yield told(out)
        if at is not None:
            yield told([(*at, digest.hexdigest())])

    def told(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])

    ship(ends.sparkSession)
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "_chunk").mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, see ``NODE``."""
    spark = conversations.sparkSession
    rebuilt, convs = rebuild(through_table(numbered_turns(conversations), "turns"))
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if(F.col("length") == 0).alias("ends")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODE)
    prefixes = through_table(prefix_digests(rebuilt), "prefixes")
    told = through_table(screened(prefixes, sketch_of(prefixes, prefixes.count(), most_cells)), "screened")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    of_self = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none)

    # Nodes that may be shared, exactly.
    shared = told.where("maybe")
    nodes = through_table(shared.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.count_if("last").alias("ends")), "nodes")
    spoken = through_table(shared.select("conv_id", "depth", "last", "a", "b").join(
        nodes.select("a", "b", F.col("conv_id").alias("speaker"), "n_convs", "size", "ends"), ["a", "b"]), "speakers")
    speaks = F.col("conv_id") == F.col("speaker")
    adds = spoken.select(
        "conv_id", (-F.col("depth")).alias("back"), "a", "b", F.lit(True).alias("is_node"),
        F.when(speaks, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).alias("saved"),
        F.when(F.col("last") & speaks & (F.col("ends") == F.col("n_convs")), 1).otherwise(0).cast("long").alias("leaves"))
    # A conversation whose end is its own is a leaf.
    alone = told.where("last AND NOT maybe").select(
        "conv_id", (-F.col("depth")).alias("back"), "a", "b", F.lit(False).alias("is_node"), F.lit(0).cast("long").alias("saved"),
        F.lit(1).cast("long").alias("leaves"))
    summed = ordered.running(adds.unionByName(alone), ["conv_id"], ["back"], {"saved": ordered.SUM, "leaves": ordered.SUM})
    subtrees = summed.where("is_node").groupBy("a", "b").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    # Children: nodes that may be shared, and the first of each conversation's own.
    firsts = told.where("NOT maybe AND pmaybe")
    children = nodes.select("pa", "pb").unionByName(firsts.select("pa", "pb")).groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    children = through_table(children, "children")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up"))

    def with_parent(rows: DataFrame) -> DataFrame:
        """The parent's speaker as ``up``; the root's is known, so that it is no hot key.

        A single prefix that the sketch could not prove single may have a parent that it did: then
        the parent is no node of ``parents``, and its one conversation is the prefix's own.
        """
        deep = rows.where("depth > 1").join(parents, ["pa", "pb"], "left").withColumn("up", F.coalesce("up", "conv_id"))
        return deep.unionByName(rows.where("depth = 1").withColumn("up", F.lit(top["least"])))

    ends = _digests_of_ends(shared.where("last").select("a", "b", "conv_id").unionByName(
        convs.where("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")))
    ends = through_table(ends, "ends")
    zero = F.lit(0).cast("long")

    grouped = (with_parent(nodes).join(subtrees, ["a", "b"])
               .join(children.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").join(ends, ["a", "b"], "left"))
    grouped = grouped.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    own = [one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
           zero.alias("saved_tokens"), of_self.alias("ends_sha256")]
    tails = told.where("NOT maybe AND NOT pmaybe").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *own)
    begun = with_parent(firsts).select("conv_id", "depth", F.col("up").alias("parent_conv_id"), *own)

    below = nodes.agg(F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved")).first()["saved"] or 0
    leaves = _leaves(spoken, told)
    at_root = (F.col("a") == 0) & (F.col("b") == 0)
    many = children.where((F.col("pa") == 0) & (F.col("pb") == 0)).first()
    hashed = ends.where(at_root).first()
    root = spark.createDataFrame([(
        top["least"], 0, None, top["n"], many["n_children"] if many else 0, leaves if many else 1, below,
        hashed["ends_sha256"] if hashed else hashlib.sha256(b"").hexdigest())], NODE)
    return tails.unionByName(begun).unionByName(grouped).unionByName(root)


def _leaves(spoken: DataFrame, told: DataFrame) -> int:
    """Childless nodes in all: shared ones by their speaker, and conversations whose end is their own."""
    common = spoken.where("last AND conv_id = speaker AND ends = n_convs").count()
    return common + told.where("last AND NOT maybe").count()
