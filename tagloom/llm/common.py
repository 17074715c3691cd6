"""Helpers shared by the text operators: reading, Arrow batches, bounded word tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Characters of text handled at once inside a task: bounds the memory of word lists.
SLICE_CHARS = 1 << 20
# Bytes of the batches that travel between Spark and its Python workers, at most.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(texts: Sequence[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of about ``most`` bytes of text, each with its texts; null is the empty text.

    Only one part at a time is turned into Python strings.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        part = batch.slice(start, stop - start)
        yield part, [x or "" for x in part.column(column).to_pylist()]
        start = stop


class WordTable(dict):
    """Numbers words as they come; new ones wait in ``words`` to be worked out together.

    ``compute(words)`` returns arrays with a value for each new word, which ``column(k)``
    then holds for all. Before the table outgrows ``most`` words it falls back to its first
    ones, the frequent ones mostly, so its memory is bounded; numbers are only good until
    the next ``index``.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence[np.ndarray]], most: int = 200_000):
        super().__init__()
        self.compute, self.most = compute, most
        self.words: list[str] = []
        self.done = 0
        self.arrays: list[np.ndarray] = []

    __hash__ = object.__hash__

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def index(self, words: Sequence[str]) -> np.ndarray:
        """Number of each word; every column is filled for all of them afterwards."""
        if len(self.words) > self.most:
            self.words = self.words[:self.most // 8]
            self.clear()
            self.update(zip(self.words, range(len(self.words))))
            self.done = len(self.words)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.done < len(self.words):
            new = self.compute(self.words[self.done:])
            if not self.arrays:
                self.arrays = [np.empty((1024, *x.shape[1:]), x.dtype) for x in new]
            for k, x in enumerate(new):
                have = self.arrays[k]
                if len(self.words) > len(have):
                    more = np.empty((max(2 * len(have), len(self.words)), *have.shape[1:]), have.dtype)
                    more[:self.done] = have[:self.done]
                    self.arrays[k] = more
                self.arrays[k][self.done:len(self.words)] = x
            self.done = len(self.words)
        return found

    def column(self, k: int) -> np.ndarray:
        return self.arrays[k] if self.arrays else np.zeros(1)


_HELD: dict = {}


def held(key, build: Callable):
    """What ``build`` made under ``key`` in this worker, kept from task to task.

    One operator's tables at a time: those of the one before are let go, so that a worker
    that serves several operators does not hold the tables of all.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def let_go() -> None:
    """Let go of what is ``held``; by name, as a function that is sent to workers has a copy of the table."""
    _HELD.clear()


def give_back() -> None:
    """Hand freed memory back to the system, which Arrow and the C library otherwise keep for later tasks.

    Spark keeps workers that wait, with all they have, beside those that work.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks that need nothing ``held``: what their worker held for another operator goes before."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(one_by_one(batches))
        give_back()
    return tidied


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; the memory that was freed since the one before goes back first."""
    give_back()
    for batch in batches:
        yield batch
        batch = None
        give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct ones of many keys, ascending; sorting beats the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, as ``--py-files`` would.

    Also holds the session's Arrow batches to ``BATCH_BYTES``, whole rows at least: long
    texts otherwise fill batches of 64 MB, several times over in an executor.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(), f"{name}_workers.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with a state per task: ``make()`` runs once, its result on each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in one_by_one(batches):
            yield from each(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a << np.uint64(6)) + (a >> np.uint64(2)))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))
