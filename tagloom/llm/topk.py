"""Exact top-k search by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks of bounded size, as are queries, and both are stored; a
task reads a group of candidate blocks and one of query blocks, and every pair of blocks
meets in one task. Nothing that grows with the pairs is shuffled or broadcast. In a block
there is a list of its rows per dimension, sorted by value. For a query the lists are read
from the end that its component favours, a stretch at a time; what was read gives each row
a lower and an upper bound of its score (unread components lie between the list's far end
and the place reached). Reading stops when the rows whose upper bound reaches the k-th
final score of the blocks that the task has done before, or the k-th lower bound while it
has none, are few; outsiders cannot qualify, and the few get their final scores in whole
numbers. Queries of a block are read for together: how far the lists were read is one
place per dimension and end, so the bounds of all queries and rows are matrix products.
The best of all tasks are then ranked.

Defined results: vectors that are null, or hold null or non-finite components, and rows
with a null id take no part; every other row is a candidate of all queries but itself, so
of rows that repeat an id each counts, and each is a query of its own; vectors of
different lengths do not meet, and two empty ones score 0; equal scores are ranked by the
smaller id; scores are exact, and one among the best that 64 bits cannot hold ends the
job, as does a component whose whole number they cannot hold; an empty table has no
results; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.shared import through_table
from .common import ship

ROWS, QUERIES = 2048, 1024  # rows of a block, on average
COMPONENTS = 1 << 20  # of a block, on average at most
GROUP, QUERY_GROUP = 64, 8  # blocks of either kind that a task reads, at most
SCALE = 256


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id and floor(scale * x) of every component x, of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    fits = lambda v: F.when(F.abs(v * scale) < 2.0 ** 63, F.floor(v * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("x", fits).alias("x"), F.size("x").alias("width"))


def _blocks(rows: DataFrame, most: int) -> int:
    n, components = rows.agg(F.count("*"), F.sum("width")).first()
    return max(1, math.ceil(n / most), math.ceil((components or 0) / COMPONENTS))


def _pack(rows: DataFrame, count: int, name: str) -> DataFrame:
    """A table row per block and vector length, with all row numbers, ids and components, these as narrow as they fit."""
    def one(key: tuple, table: pa.Table) -> pa.Table:
        numbers, ids = (table.column(c).to_numpy() for c in ("row", "id"))
        x = table.column("x").combine_chunks().flatten().to_numpy()
        x = x.astype(next(t for t in (np.int16, np.int32, np.int64) if largest(x) <= np.iinfo(t).max or t == np.int64))
        return pa.table(
            {name: [key[0].as_py()], "width": [key[1].as_py()], "rows": [numbers.tobytes()], "ids": [ids.tobytes()], "vectors": [x.tobytes()]},
            pa.schema([(name, pa.int32()), ("width", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    block = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(name)
    return rows.select(block, "width", "row", "id", "x").groupBy(name, "width").applyInArrow(
        one, f"{name} int, width int, rows binary, ids binary, vectors binary")


def _unpacked(rows: bytes, ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers = np.frombuffer(rows, np.int64)
    bits = 8 * len(vectors) // max(1, len(numbers) * width) or 64
    return numbers, np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"int{bits}").astype(np.int64).reshape(len(numbers), width)


def largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers, of any size where 64 bits might not do."""
    if largest(vectors) * largest(query) * max(1, len(query)) < 1 << 63:
        return vectors @ query
    return np.array([sum(a * b for a, b in zip(v, query.tolist())) for v in vectors.tolist()], dtype=object)


def first_of(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    if scores.dtype != object:
        order = np.lexsort((ids, -scores, asked))
    else:
        order = np.array(sorted(range(len(ids)), key=lambda j: (asked[j], -scores[j], ids[j])), dtype=np.int64)
    grouped = asked[order]
    return order[np.arange(len(order)) - np.searchsorted(grouped, grouped) < k]


class SortedLists:
    """One block's rows, with a sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.values, self.largest = np.sort(vectors, axis=0), largest(vectors)
        self.typed: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def best(self, own: int, query: np.ndarray, k: int, bar: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than ``own`` that reach ``bar``, ties to smaller ids."""
        asked, ids, scores = self.candidates(np.array([own]), query[None], k, np.array([bar]))
        first = first_of(asked, ids, scores, k)
        return ids[first], scores[first]

    def candidates(self, owns: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and final score of rows other than the query's own: all that may be among
        the k best of a query and reach its bar."""
        keep = owns[:, None] != self.rows
        if len(self.rows) > 4 * k + 1:
            keep = self._survivors(queries, keep, k, bars)
        asked, places = np.divmod(np.flatnonzero(keep), max(1, len(self.rows)))
        x, q, exact = self._as(queries)
        if not exact:
            cuts = np.searchsorted(asked, np.arange(len(queries) + 1))
            found = [products(self.vectors[places[a:b]], query) for query, a, b in zip(queries, cuts, cuts[1:])]
            return asked, self.ids[places], np.concatenate(found) if found else np.zeros(0, np.int64)
        if 16 * len(asked) > keep.size:
            scores = (q @ x.T)[keep]
        else:
            scores = np.einsum("ij,ij->i", q[asked], x[places])
        high = scores >= bars[asked]
        return asked[high], self.ids[places[high]], scores[high].astype(np.int64)

    def _as(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Vectors and queries as floats, as short as hold all sums of their products, and whether they do."""
        a, b = self.largest, largest(queries)
        most = max(a, b, a * b * queries.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64
        if kind not in self.typed:
            self.typed[kind] = self.vectors.astype(kind), self.values.astype(kind)
        return self.typed[kind][0], queries.astype(kind), most < 1 << 53

    def _survivors(self, queries: np.ndarray, others: np.ndarray, k: int, bars: np.ndarray) -> np.ndarray:
        """Per query the rows that its bounds leave, at least those of the k best that reach its bar."""
        queries, others, bars = np.atleast_2d(queries), np.atleast_2d(others), np.atleast_1d(bars)
        x, q, exact = self._as(queries)
        values, n = self.typed[x.dtype.type][1], len(x)
        up, down = np.maximum(q, 0), np.minimum(q, 0)  # lists read from their large end, and from their small end
        # Whole numbers that a float holds have exact bounds.
        slack = (0 if exact else 1e-12) * np.maximum(np.abs(q * values[0]), np.abs(q * values[-1])).sum(1)
        few, keep, unread = max(4 * k, n // 32), np.zeros(others.shape, bool), np.arange(len(q))
        hi = max(1, 5 * n // 8)
        while True:
            top, bottom = values[n - hi], values[hi - 1]  # the places reached
            high = up[unread] @ np.maximum(x, top).T + down[unread] @ np.minimum(x, bottom).T
            reached = bars[unread]
            new = np.flatnonzero(np.isneginf(reached))
            if len(new):
                low = up[unread[new]] @ np.where(x >= top, x, values[0]).T + down[unread[new]] @ np.where(x <= bottom, x, values[-1]).T
                low[~others[unread[new]]] = -np.inf
                reached[new] = np.partition(low, n - k, axis=1)[:, n - k]
            left = others[unread] & (high >= (reached - slack[unread]).astype(x.dtype)[:, None])
            done = np.full(len(unread), hi == n) | (left.sum(1) <= few)
            keep[unread[done]], unread = left[done], unread[~done]
            if not len(unread):
                return keep
            hi = min(n, hi + max(1, n // 8))


class Asked:
    """A block of queries, with the k best rows found so far for each."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.asked = self.found = self.scores = np.zeros(0, np.int64)
        self.bars = np.full(len(rows), -math.inf)

    def meet(self, block: SortedLists) -> None:
        more = block.candidates(self.rows, self.vectors, self.k, self.bars)
        asked, found, scores = (np.append(a, b) for a, b in zip((self.asked, self.found, self.scores), more))
        first = first_of(asked, found, scores, self.k)
        self.asked, self.found, self.scores = asked[first], found[first], scores[first]
        ends = np.cumsum(np.bincount(self.asked, minlength=len(self.rows)))
        full = np.diff(ends, prepend=0) == self.k
        self.bars[full] = self.scores[ends[full] - 1].astype(np.float64)


def _searched(k: int):
    def run(batches):
        at, block = None, None  # the block at hand; all query blocks of the task meet it one after another
        queries: dict[tuple, Asked] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
                width = of("width")
                if at != (of("block"), width):
                    at, block = (of("block"), width), SortedLists(*_unpacked(of("rows"), of("ids"), of("vectors"), width))
                key = of("asked"), width
                if key not in queries:
                    queries[key] = Asked(*_unpacked(of("query_rows"), of("query_ids"), of("query_vectors"), width), k)
                queries[key].meet(block)
        for q in queries.values():
            columns = [q.rows[q.asked], q.ids[q.asked], q.found, q.scores]
            # A score beyond 64 bits raises here.
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in columns], ["query_row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each id divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = through_table(whole_numbers(vectors, key, vector), "vectors")
    asked = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    blocks, query_blocks = _blocks(rows, ROWS), _blocks(asked, QUERIES)
    query_groups = math.ceil(query_blocks / QUERY_GROUP)
    groups = min(blocks, max(math.ceil(blocks / GROUP), math.ceil(4 * spark.sparkContext.defaultParallelism / query_groups)))
    left = through_table(_pack(rows, blocks, "block"), "blocks").repartitionById(groups, F.col("block") % groups)
    right = through_table(_pack(asked, query_blocks, "asked"), "queries").select(
        "asked", F.col("width").alias("query_width"), F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"),
        F.col("vectors").alias("query_vectors")).repartitionById(query_groups, F.col("asked") % query_groups)
    # The hint asks for a product of partitions read where they are compared; a difference is no key to deal rows out by.
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("width") - F.col("query_width") == 0)
    found = met.mapInArrow(_searched(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
