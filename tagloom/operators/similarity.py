"""Cosine similarity of vectors: pairs over a threshold, nearest neighbours, graph.

The exact operators compare blocks of vectors. Each vector gets a home block; two
blocks meet in one task of bounded size, where a matrix product finds the pairs and
only those that pass the threshold (for the graph: only the best few of each row)
leave it. Blocks lie around pivots, and the angle between unit vectors obeys the
triangle inequality, so blocks too far apart for the threshold never meet; how much
that saves depends on how clustered the vectors are. No pair is missed or capped.

The work still grows with the square of the vectors where they are not clustered. The
approximate form, ``cosine_pairs_approx``, hashes vectors by random hyperplanes instead and
lets only buckets meet whose signatures differ in few bits; how many bits, tables and
differing bits follows from the threshold, the recall asked for and the number of vectors.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations
from typing import Any, NamedTuple, Tuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import NORM_FLOOR, cosine
from ..plans.shared import through_table

# The functions below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarity an edge needs, edges per node.
EDGE_THRESHOLD = 0.8
EDGES_PER_NODE = 6

# Vectors per block, and rows of a block multiplied at a time: 64 MB per product.
BLOCK_ROWS = 8192
SLICE_ROWS = 1024
# Pivots are collected and shipped to every task, so their number is bounded.
MAX_PIVOTS = 256
# Added to every angle bound, against rounding at the edge of a block.
ANGLE_SLACK = 1e-6

# Of the approximate form: recall asked for, and bounds of what a plan may use. A shipped
# vector costs about as much as this many products.
RECALL = 0.95
MAX_BITS, MAX_FLIPS, MAX_TABLES = 14, 2, 24
SHIPPING = 200
# Files that blocks are stored in where all of them meet, at most.
MAX_FILES = 1024

PAIR_SCHEMA = "src bigint, dst bigint, w double"


def _unit_rows(column: pd.Series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    norms[norms == 0] = NORM_FLOOR
    return matrix / norms[:, None]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _pick_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """A bounded number of vectors, chosen by hash so that a rerun picks the same."""
    rows = (vectors.where(F.size("vec") > 0)
            .select("tid", "vec", F.xxhash64("tid").alias("h"))
            .orderBy("h", "tid").limit(count).select("vec").toPandas())
    return _unit_rows(rows["vec"]) if len(rows) else np.zeros((0, 1))


class _Layout:
    """Pivots with the size, radius and number of blocks of their cells."""

    def __init__(self, vectors: DataFrame, block_rows: int):
        total = vectors.count()
        wanted = max(1, min(MAX_PIVOTS, math.ceil(total / block_rows)))
        self.pivots = _pick_pivots(vectors, wanted)
        self.blocks = np.ones(len(self.pivots), dtype=np.int64)
        self.radius = np.full(len(self.pivots), math.pi)
        if len(self.pivots) > 1:
            pivots = self.pivots

            def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        angles = _angles(_unit_rows(pdf["vec"]), pivots)
                        home = angles.argmin(axis=1)
                        yield pd.DataFrame({"home": home, "angle": angles[np.arange(len(home)), home]})

            cells = (vectors.select("vec").mapInPandas(locate, "home bigint, angle double")
                     .groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
                     .collect())  # one row per pivot
            self.radius[:] = -1.0
            for cell in cells:
                self.radius[cell["home"]] = cell["radius"]
                self.blocks[cell["home"]] = max(1, math.ceil(cell["n"] / block_rows))
        elif len(self.pivots) == 1:
            self.blocks[0] = max(1, math.ceil(total / block_rows))
        self.first = np.concatenate([[0], np.cumsum(self.blocks)[:-1]]).astype(np.int64)


def _block_pairs(vectors: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Each vector once per meeting of its home block with another: (lo, hi, side, ...)."""
    layout = _Layout(vectors, block_rows)
    pivots, radius, blocks, first = layout.pivots, layout.radius, layout.blocks, layout.first
    reach = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            if len(pivots) > 1:
                angles = _angles(_unit_rows(pdf["vec"]), pivots)
                home = angles.argmin(axis=1)
                near = (radius >= 0) & (angles <= radius + reach)
                near[np.arange(len(home)), home] = True
            else:
                home = np.zeros(len(pdf), dtype=np.int64)
                near = np.ones((len(pdf), 1), dtype=bool)
            own = first[home] + pdf["salt"].to_numpy() % blocks[home]
            for pivot in range(near.shape[1]):
                rows = np.flatnonzero(near[:, pivot])
                if not len(rows):
                    continue
                part, mine = pdf.iloc[rows], own[rows]
                for block in range(first[pivot], first[pivot] + blocks[pivot]):
                    yield pd.DataFrame({
                        "lo": np.minimum(mine, block), "hi": np.maximum(mine, block),
                        "own": mine, "tid": part["tid"].to_numpy(), "vec": part["vec"].to_numpy()})

    salted = vectors.select("tid", "vec", F.pmod(F.xxhash64("tid"), F.lit(1 << 30)).alias("salt"))
    return salted.mapInPandas(spread, "lo bigint, hi bigint, own bigint, tid bigint, vec array<float>")


def _between(threshold: float, best: int | None):
    """Function of two blocks, or twice the same one: their similar pairs, slice by slice."""

    def strongest(ids: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        src, dst = np.nonzero((sims >= threshold) & (ids[:, None] != others[None, :]))
        found = pd.DataFrame({"src": ids[src], "dst": others[dst], "w": sims[src, dst]})
        if best is not None and len(found):
            found = (found.sort_values(["src", "w", "dst"], ascending=[True, False, True])
                     .groupby("src").head(best))
        return found

    def between(left_ids: np.ndarray, left: np.ndarray, right_ids: np.ndarray, right: np.ndarray,
                same: bool) -> Iterator[pd.DataFrame]:
        for at in range(0, len(left), SLICE_ROWS):
            cut = slice(at, at + SLICE_ROWS)
            yield strongest(left_ids[cut], right_ids, left[cut] @ right.T)
        if not same:
            for at in range(0, len(right), SLICE_ROWS):
                cut = slice(at, at + SLICE_ROWS)
                yield strongest(right_ids[cut], left_ids, right[cut] @ left.T)

    return between


def _meet(threshold: float, best: int | None):
    """Grouped function: similar pairs between the two blocks that meet in a task."""
    between = _between(threshold, best)

    def meet(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = key
        pdf = pd.concat(list(batches), ignore_index=True)  # two blocks
        a = pdf[pdf["own"] == lo]
        b = pdf[pdf["own"] == hi] if hi != lo else a
        if not len(a) or not len(b):
            return
        yield from between(a["tid"].to_numpy(), _unit_rows(a["vec"]), b["tid"].to_numpy(), _unit_rows(b["vec"]), hi == lo)

    return meet


def _all_pairs(vectors: DataFrame, threshold: float, total: int, block_rows: int) -> DataFrame:
    """Similar pairs of all vectors, for plans without bits.

    Vectors are shuffled once, into blocks of a row each, which are stored; then each task
    reads the blocks that it compares. Nothing that grows with the pairs is shuffled.
    """
    count = max(1, math.ceil(total / block_rows))

    def pack(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)  # one block
        matrix = np.stack([np.asarray(v, dtype=np.float32) for v in pdf["vec"]])
        ids = [None if pd.isna(x) else int(x) for x in pdf["tid"]]
        yield pd.DataFrame({"block": [key[0]], "ids": [ids], "vecs": [matrix.tobytes()]})

    salt = F.pmod(F.xxhash64("tid"), F.lit(1 << 30)) % F.lit(count)
    packed = vectors.select(salt.alias("block"), "tid", "vec").repartition(min(count, MAX_FILES), "block").groupBy("block").applyInPandas(
        pack, "block bigint, ids array<bigint>, vecs binary")
    blocks = through_table(packed, "blocks")
    left = blocks.select(F.col("block").alias("lo"), F.col("ids").alias("lo_ids"), F.col("vecs").alias("lo_vecs"))
    right = blocks.select(F.col("block").alias("hi"), F.col("ids").alias("hi_ids"), F.col("vecs").alias("hi_vecs"))
    between = _between(threshold, None)

    def rows(ids: np.ndarray, vecs: bytes) -> np.ndarray:
        return _unit(np.frombuffer(vecs, np.float32).reshape(len(ids), -1).astype(np.float64))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, a, x, hi, b, y in zip(*(pdf[c] for c in ("lo", "lo_ids", "lo_vecs", "hi", "hi_ids", "hi_vecs"))):
                yield from between(np.asarray(a), rows(a, x), np.asarray(b), rows(b, y), lo == hi)

    # The hint asks for a product of partitions read where they are compared: no exchange, no broadcast.
    return left.join(right.hint("shuffle_replicate_nl"), F.col("lo") <= F.col("hi")).mapInPandas(meet, PAIR_SCHEMA)


def vector_copies(vectors: DataFrame) -> DataFrame:
    """(tid, content): which vectors are the same, number for number."""
    return vectors.where("vec is not null").select("tid", _content())


def _content():
    return F.unhex(F.sha2(F.to_json(F.struct("vec")), 256)).alias("content")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(content, tid, vec): each different vector once, under its smallest id.

    Copies collapse before the exchange, so a group of copies of any size is one row
    per map task.
    """
    return (vectors.where("vec is not null").groupBy(_content())
            .agg(F.min("tid").alias("tid"), F.any_value("vec").alias("vec")))


def cosine_pairs(vectors: DataFrame, threshold: float = EDGE_THRESHOLD,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All ordered pairs (src, dst, w) of different vectors with at least this similarity.

    Vectors are named by the smallest id that has them; ``vector_copies`` tells the
    others. Copies are not paired with one another row by row: a group of m copies
    would give m * m rows that say nothing more.
    """
    single = through_table(distinct_vectors(vectors), "vectors")
    blocks = _block_pairs(single, threshold, block_rows)
    return blocks.groupBy("lo", "hi").applyInPandas(_meet(threshold, None), PAIR_SCHEMA)


def copies_of(vectors: DataFrame) -> DataFrame:
    """(tid, rep): every vector and the smallest id that has the same one, its name in ``cosine_pairs``."""
    names = distinct_vectors(vectors).select("content", F.col("tid").alias("rep"))
    # The names are unique by content; adaptive execution can split the side of a hot content.
    return vector_copies(vectors).join(names, "content").select("tid", "rep")


class BucketPlan(NamedTuple):
    """How hyperplanes hash: bits of a signature, bits in which buckets that meet differ at most, tables."""

    bits: int
    flips: int
    tables: int

    def recall(self, threshold: float) -> float:
        """Chance that two vectors of this similarity meet; more similar ones meet more often."""
        differ = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        meet = sum(math.comb(self.bits, f) * differ ** f * (1 - differ) ** (self.bits - f) for f in range(self.flips + 1))
        return 1 - (1 - min(1.0, meet)) ** self.tables

    def cost(self, count: int) -> float:
        """Products of two vectors, for vectors without any structure, and vectors shipped."""
        shipped = self.tables * sum(math.comb(self.bits, f) for f in range(self.flips + 1))
        return count * (shipped * count / 2 ** (self.bits + 1) + SHIPPING * shipped)


def bucket_plan(threshold: float, count: int, recall: float = RECALL) -> BucketPlan:
    """The cheapest plan that keeps the recall at the threshold; without bits all vectors meet."""
    best = BucketPlan(0, 0, 1)
    for bits in range(1, MAX_BITS + 1):
        for flips in range(min(bits, MAX_FLIPS + 1)):
            one = BucketPlan(bits, flips, 1).recall(threshold)
            tables = math.ceil(math.log(1 - recall) / math.log(1 - one)) if one < recall else 1
            plan = BucketPlan(bits, flips, tables)
            if tables <= MAX_TABLES and plan.cost(count) < best.cost(count):
                best = plan
    return best


def _bucket_pairs(vectors: DataFrame, plan: BucketPlan, block_rows: int) -> DataFrame:
    """As ``_block_pairs``, for blocks of equal signatures: (lo, hi, side, ...) once per meeting.

    Large buckets are cut into blocks of about ``block_rows``, so no meeting is large
    however many vectors share a signature.
    """
    first = vectors.select(F.size("vec").alias("n")).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "lo bigint, hi bigint, own bigint, tid bigint, vec array<float>")
    bits, flips, tables = plan
    planes = np.random.default_rng(11).standard_normal((first[0]["n"], tables * bits)) if bits else None
    powers = 1 << np.arange(bits, dtype=np.int64)

    def signatures(vecs: pd.Series) -> np.ndarray:
        if not bits:
            return np.zeros((len(vecs), tables), dtype=np.int64)
        sides = (_unit_rows(vecs) @ planes > 0).reshape(len(vecs), tables, bits)
        return sides @ powers

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = signatures(pdf["vec"])
                yield pd.DataFrame({"bucket": (found + (np.arange(tables) << bits)).ravel()})

    # At most MAX_TABLES << MAX_BITS buckets, whatever the vectors.
    sizes = np.zeros(tables << bits, dtype=np.int64)
    counted = vectors.select("vec").mapInPandas(locate, "bucket bigint").groupBy("bucket").count()
    for row in counted.collect():
        sizes[row["bucket"]] = row["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))
    start = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    masks = [sum(1 << b for b in chosen) for f in range(flips + 1) for chosen in combinations(range(bits), f)]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            found, salt = signatures(pdf["vec"]), pdf["salt"].to_numpy()
            for table in range(tables):
                base = table << bits
                home = found[:, table] + base
                own = start[home] + salt % blocks[home]
                for mask in masks:
                    other = (found[:, table] ^ mask) + base
                    for turn in range(int(blocks[other].max())):
                        rows = np.flatnonzero((turn < blocks[other]) & (sizes[other] > 0))
                        if not len(rows):
                            continue
                        block, mine, part = start[other[rows]] + turn, own[rows], pdf.iloc[rows]
                        yield pd.DataFrame({
                            "lo": np.minimum(mine, block), "hi": np.maximum(mine, block), "own": mine,
                            "tid": part["tid"].to_numpy(), "vec": part["vec"].to_numpy()})

    salted = vectors.select("tid", "vec", F.pmod(F.xxhash64("tid"), F.lit(1 << 30)).alias("salt"))
    return salted.mapInPandas(spread, "lo bigint, hi bigint, own bigint, tid bigint, vec array<float>")


def cosine_pairs_approx(vectors: DataFrame, threshold: float = EDGE_THRESHOLD, recall: float = RECALL,
                        block_rows: int = BLOCK_ROWS, plan: BucketPlan | None = None) -> DataFrame:
    """``cosine_pairs`` that finds each pair with a chance of ``recall`` at least.

    What it finds is exact: pairs are compared by their vectors, and none below the
    threshold is returned. Where hashing does not pay (few vectors, a low threshold) all
    vectors meet and nothing is missed.
    """
    single = through_table(distinct_vectors(vectors), "vectors")
    total = single.count()
    chosen = plan or bucket_plan(threshold, total, recall)
    if not chosen.bits:
        return _all_pairs(single, threshold, total, block_rows)
    found = _bucket_pairs(single, chosen, block_rows).groupBy("lo", "hi").applyInPandas(_meet(threshold, None), PAIR_SCHEMA)
    if chosen.tables == 1:  # in one table a pair meets once
        return found
    # A pair that meets in several tables has the same similarity, but for rounding, in each.
    return found.groupBy("src", "dst").agg(F.max("w").alias("w"))


def topk_neighbours(pairs: DataFrame, k: int = EDGES_PER_NODE, threshold: float = EDGE_THRESHOLD,
                    vectors: DataFrame | None = None) -> DataFrame:
    """Per node the k most similar others over the threshold; ties by the smaller id.

    Pairs of ``cosine_pairs`` are between the names of equal vectors. With ``vectors``,
    every id gets its neighbours, copies of it and copies of its neighbours included;
    without, the ids are those of the pairs.
    """
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    near = (pairs.where((F.col("src") != F.col("dst")) & (F.col("w") >= threshold))
            .withColumn("rank", rank).where(F.col("rank") <= k))
    return near if vectors is None else _for_all_copies(near, vectors, threshold, k)


def _for_all_copies(near: DataFrame, vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k best of every id, given the k best different vectors of every different vector.

    A vector stands for all ids that have it, of which no node can use more than the
    k + 1 smallest; these are carried through the ranking.
    """
    per_content = Window.partitionBy("content").orderBy("tid")
    members = (vector_copies(vectors).withColumn("n", F.row_number().over(per_content))
               .where(F.col("n") <= k + 1)
               .groupBy("content").agg(F.collect_list("tid").alias("ids"), F.min("tid").alias("rep")))
    own = (distinct_vectors(vectors).select("tid", F.round(cosine(F.col("vec"), F.col("vec")), 12).alias("w"))
           .where(F.col("w") >= threshold))
    reached = near.select("src", "dst", "w").unionByName(
        own.select(F.col("tid").alias("src"), F.col("tid").alias("dst"), "w"))
    # At most k + 1 vectors with k + 1 ids each per source.
    choices = (
        reached.join(members.select(F.col("rep").alias("dst"), "ids"), "dst")
        .select("src", F.explode("ids").alias("dst"), "w")
        .groupBy("src").agg(F.slice(F.array_sort(F.collect_list(
            F.struct((-F.col("w")).alias("nw"), F.col("dst").alias("dst")))), 1, k + 1).alias("best")))
    # One list per content; its copies, however many, meet it in one join whose hot side
    # adaptive execution can split.
    lists = choices.join(members.select("content", F.col("rep").alias("src")), "src").select(
        "content", "best")
    return (
        vector_copies(vectors).join(lists, "content")
        .withColumn("best", F.slice(F.filter("best", lambda b: b["dst"] != F.col("tid")), 1, k))
        .select(F.col("tid").alias("src"), F.posexplode("best").alias("rank", "b"))
        .select("src", "b.dst", (-F.col("b.nw")).alias("w"), (F.col("rank") + 1).alias("rank")))


def similarity_graph(vectors: DataFrame, threshold: float = EDGE_THRESHOLD,
                     k: int = EDGES_PER_NODE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (src, dst, w, rank) to the k nearest neighbours over the threshold.

    Exact, copies included. Neighbours are found among different vectors, and each
    meeting of blocks keeps k candidates per vector: the k best overall are among the k
    best of every meeting.
    """
    single = through_table(distinct_vectors(vectors), "vectors")
    blocks = _block_pairs(single, threshold, block_rows)
    near = blocks.groupBy("lo", "hi").applyInPandas(_meet(threshold, k), PAIR_SCHEMA)
    return topk_neighbours(near, k, threshold, vectors)


def per_model(vectors: DataFrame, operator, **options) -> DataFrame:
    """``operator`` on the vectors of each model by themselves, with the model as ``mdl``.

    Vectors of different lengths do not meet either, so neither ends the job. The models
    in use are few, as are their lengths: their names come to the driver.
    """
    groups = vectors.where("vec IS NOT NULL").select("mdl", F.size("vec").alias("n")).distinct().orderBy("mdl", "n").collect()
    found = None
    for g in groups:
        own = vectors.where(F.col("mdl").eqNullSafe(F.lit(g["mdl"])) & (F.size("vec") == g["n"])).drop("mdl")
        part = operator(own, **options).withColumn("mdl", F.lit(g["mdl"]).cast("string"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = operator(vectors.drop("mdl").limit(0), **options).withColumn("mdl", F.lit(None).cast("string"))
    return found


def cosine_with(vectors: DataFrame, other: list[float]) -> DataFrame:
    """Similarity of every vector with one given vector."""
    given = F.array(*[F.lit(float(x)) for x in other])
    return vectors.select("tid", cosine(F.col("vec"), given).alias("w"))
