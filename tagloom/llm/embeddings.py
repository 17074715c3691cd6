"""Text classifiers on averaged embeddings of hashed words and character n-grams.

A document is the mean of the learned vectors of its features: each word, each pair of
neighbouring words (a repeated word is one feature of its own, whatever the word) and, as
much as one of these together, the character n-grams of each word between boundary
marks. Where asked, features whose share of documents hardly differs between the classes
have no vector and a small weight in the mean, so that a few telling words are not lost in
a long text, nor one chance n-gram taken for many. A linear softmax on that mean gives the
class; vectors and softmax are trained together by gradient descent on all labelled documents.

As everything between the vectors and the class is linear, a trained model is one number
per bucket; scoring adds the numbers of a text's features and divides by their weight. The
same holds in training: all that a step needs of the documents is, per bucket, the sum of
their errors times the bucket's share in them. Spark adds these sums up over a table of
words, whose n-grams are made anew in each round, as they take many times the words' space;
the driver holds the vectors, whose size ``Features`` and ``Training`` fix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import InitVar, dataclass, field, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table
from .common import WordTable, distinct, held, map_arrow, mix, ragged, ship, text_of, text_slices, tidy


@dataclass(frozen=True)
class Features:
    """What a text is described by. ``bits``: size of the hashed table, as a power of 2."""

    bits: int = 17
    shortest: int = 3
    longest: int = 5
    pairs: bool = True
    fold: bool = False

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.bits) - 1)

    def words(self, text: str) -> list[str]:
        return (text.lower() if self.fold else text).split()

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word; word number, bucket and weight of every feature inside words."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        of = np.repeat(np.arange(len(words)), lengths)
        numbers, buckets = [np.arange(len(words))], [own & self.mask]
        for _, inside, found in self.grams(codes, lengths):
            numbers.append(of[inside])
            buckets.append(found)
        at = np.concatenate(numbers)
        grams = np.maximum(np.bincount(at, minlength=len(words)) - 1, 1)
        weight = 1.0 / grams[at]
        weight[:len(words)] = 1.0
        return own, at, np.concatenate(buckets).astype(np.int64), weight

    def grams(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of words with their marks, one after another: each length of n-grams, places and buckets of those inside words."""
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        rolled = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                rolled = rolled[:max(0, len(codes) - n + 1)] * np.uint64(1_000_003) + codes[n - 1:]
                if n < self.shortest:
                    continue
                inside = np.flatnonzero(left[:len(rolled)] >= n)
                x = rolled[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                yield n, inside, (x ^ (x >> np.uint64(32))) & self.mask

    def of_pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket of each pair of neighbouring words."""
        left, right = hashes[:-1], hashes[1:]
        found = (mix(left, right) & self.mask).astype(np.int64)
        found[left == right] = 1  # one feature for all repetitions
        return found


@dataclass(frozen=True)
class Training:
    """``most`` bounds the documents of one row of the table of words, ``batch`` those whose
    distinct features are listed at once; every labelled document is trained on, in every round."""

    most: int = 4096
    width: int = 16
    rounds: int = 16
    batch: int = 64
    rate: float = 0.5
    seed: int = 7
    telling: float = 0.0  # standard errors by which a feature's share must differ between classes
    rest: float = 0.01  # weight of the features that differ less


@dataclass
class Model:
    features: Features
    weights: np.ndarray  # one number per bucket
    mass: np.ndarray  # what a feature of each bucket counts in the mean
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


# Numbers are added up as multiples of these, so that sums do not depend on how rows are dealt.
WEIGHT, VALUE, ERROR = 2.0 ** -16, 2.0 ** -24, 2.0 ** -32


ROLLED = 1 << 16  # characters whose n-grams are made at once
GRAMS = 1 << 20  # n-grams that a number is looked up or added up for at once


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs (first, after the last) of things of these sizes, ``most`` or one thing together."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


@dataclass
class Chunk:
    """Words of some labelled documents: what a row of the table of words holds."""

    label: np.ndarray  # 0 or 1, of each document
    sizes: np.ndarray  # distinct words of each
    word: np.ndarray  # their numbers, one document after another
    times: np.ndarray  # and how often each stands
    own: np.ndarray  # bucket of each word
    lengths: np.ndarray  # its characters, marks included
    text: np.ndarray  # words with their marks, in UTF-8
    pairs: np.ndarray  # pairs of neighbouring words of each document
    pair: np.ndarray  # their buckets
    features: InitVar[Features]

    def __post_init__(self, features: Features):
        documents = np.arange(len(self.label), dtype=np.int32)
        self.doc, self.pair_doc = np.repeat(documents, self.sizes), np.repeat(documents, self.pairs)
        counts = {n: np.maximum(self.lengths - n + 1, 0) for n in range(features.shortest, features.longest + 1)}
        self.many = sum(counts.values(), np.ones(len(self.own), np.int64))  # buckets of each word: its own, then its n-grams'
        self.first = np.cumsum(self.many) - self.many
        self.weight = np.rint(1 / np.maximum(self.many - 1, 1) / WEIGHT) * WEIGHT  # of each n-gram; the word itself has 1
        self.grams = np.empty(self.many.sum(), np.int32)
        self.grams[self.first] = self.own
        codes = np.frombuffer(self.text.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        for a, b in stretches(self.lengths, ROLLED):
            begin, lengths, after = begins[a], self.lengths[a:b], self.first[a:b] + 1
            for n, inside, buckets in features.grams(codes[begin:begin + lengths.sum()].astype(np.uint64), lengths):
                self.grams[np.repeat(after - (begins[a:b] - begin), counts[n][a:b]) + inside] = buckets
                after = after + counts[n][a:b]

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some words at a time, their buckets, and where each word's begin."""
        for a, b in stretches(self.many, GRAMS):
            begin = self.first[a]
            yield slice(a, b), self.grams[begin:self.first[b - 1] + self.many[b - 1]], self.first[a:b] - begin

    def per_text(self, x: np.ndarray | None) -> np.ndarray:
        """Sum over each document's features of a number per bucket, 1 if None, times the feature's weight."""
        words = 1 + (self.many - 1) * self.weight
        if x is not None:
            for some, grams, first in self.parts():
                found = x[grams]
                own = found[first]
                words[some] = own + (np.add.reduceat(found, first) - own) * self.weight[some]
        words = np.rint(words / VALUE)
        pairs = self.pairs / VALUE if x is None else np.bincount(self.pair_doc, np.rint(x / VALUE)[self.pair], len(self.label))
        return (np.bincount(self.doc, words[self.word] * self.times, len(self.label)) + pairs) * VALUE

    def per_bucket(self, x: np.ndarray, size: int) -> np.ndarray:
        """Sum over the documents that have a bucket of a number per document times the weight."""
        words = np.bincount(self.word, x[self.doc] * self.times, len(self.many))
        out = np.bincount(self.pair, x[self.pair_doc], size).astype(float)  # whole numbers where there are no pairs
        for some, grams, first in self.parts():
            each = np.repeat(words[some] * self.weight[some], self.many[some])
            each[first] = words[some]
            out += np.bincount(grams, each, size)
        return out

    def classes(self, size: int, batch: int) -> np.ndarray:
        """How many documents of class 0 and of class 1 have each bucket; ``batch`` documents or fewer at a time."""
        out = np.zeros((2, size))
        words, pairs = np.append(0, np.cumsum(self.sizes)), np.append(0, np.cumsum(self.pairs))
        each = np.bincount(self.doc, self.many[self.word], len(self.label)) + self.pairs
        for c, d in stretches(np.maximum(each, GRAMS // batch), GRAMS):
            own, two = slice(words[c], words[d]), slice(pairs[c], pairs[d])
            many = self.many[self.word[own]]
            keys = distinct(np.append(np.repeat(self.doc[own].astype(np.int64) * size, many) + self.grams[ragged(self.first[self.word[own]], many)],
                                      self.pair_doc[two].astype(np.int64) * size + self.pair[two]))
            of, bucket = np.divmod(keys, size)
            for k in (0, 1):
                out[k] += np.bincount(bucket[self.label[of] == k], minlength=size)
        return out


COLUMNS = [x.name for x in fields(Chunk)]
KINDS = {"label": np.uint8, "text": np.uint8}  # of the columns' numbers, 32 bits otherwise


def rows_of(features: Features, texts: list[str], labels: list[int], most: int) -> Iterator[list[np.ndarray]]:
    """The words of labelled texts, ``most`` of the texts at a time."""
    for c in range(0, len(texts), most):
        split = [features.words(t) for t in texts[c:c + most]]
        number: dict[str, int] = {}
        for words in split:
            for w in words:
                number.setdefault(w, len(number))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        doc, here = np.repeat(np.arange(len(split)), sizes), np.fromiter((number[w] for words in split for w in words), np.int64, sizes.sum())
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        lengths = np.fromiter(map(len, number), np.int64, len(number)) + 2
        text = np.frombuffer("".join(f"<{w}>" for w in number).encode(), np.uint8)
        pair, pairs = np.zeros(0, np.int64), np.zeros(len(split), np.int64)
        if features.pairs and len(here):
            inside = doc[:-1] == doc[1:]
            pair, pairs = features.of_pairs(own[here])[inside], np.maximum(sizes - 1, 0)
        both, times = np.unique(doc * max(len(number), 1) + here, return_counts=True)
        of, word = np.divmod(both, max(len(number), 1))
        label = np.asarray(labels[c:c + most], np.int64) != 0
        columns = label, np.bincount(of, minlength=len(split)), word, times, own & features.mask, lengths, text, pairs, pair
        yield [x.astype(KINDS.get(name, np.int32)) for name, x in zip(COLUMNS, columns)]


#: Adds up an array over all chunks: given what to make of each, and the array's length.
Sums = Callable[[Callable[[Chunk], np.ndarray], int], np.ndarray]


def _telling(in0: np.ndarray, in1: np.ndarray, n0: float, n1: float, least: float) -> np.ndarray:
    """Which buckets' share of documents differs between classes by ``least`` standard errors."""
    p = (in1 + in0 + 1) / (n0 + n1 + 2)
    return np.abs(in1 / n1 - in0 / n0) >= least * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def train(texts: list[str], labels: list[int], features: Features, how: Training = Training()) -> Model:
    """A model from texts at hand."""
    chunks = [Chunk(*row, features) for row in rows_of(features, texts, labels, how.most)]
    return descend(lambda each, size: sum(map(each, chunks), np.zeros(size)), features, how)


def descend(summed: Sums, features: Features, how: Training) -> Model:
    """Vectors and softmax by gradient descent, vectors scaled by their past gradients.

    A step takes all documents. The gradient of a bucket's vector is the difference of the
    softmax' columns times the sum of errors, each times the bucket's share in the document;
    the softmax' own gradient is the vectors' sum by the same numbers. So a number per bucket
    goes out, and one comes back. Without documents the score is 1/2 everywhere; with one
    class it is that class's.
    """
    size = 1 << features.bits
    if how.telling > 0:
        found = summed(lambda chunk: np.append(chunk.classes(size, how.batch), np.bincount(chunk.label, minlength=2)), 2 * size + 2)
    else:
        found = summed(lambda chunk: np.bincount(chunk.label, minlength=2).astype(float), 2)
    n0, n1 = found[-2:]
    if not n0 or not n1:
        none = np.zeros(size, np.float32)
        return Model(features, none, none, float(8 * (n1 - n0) / max(n0 + n1, 1)))
    telling = _telling(found[:size], found[size:2 * size], n0, n1, how.telling) if how.telling > 0 else np.ones(size, bool)
    mass = np.where(telling, 1, np.float32(how.rest)).astype(np.float32)
    rng = np.random.default_rng(how.seed)
    # Vectors start at zero, so that features never seen in training say nothing.
    vectors = np.zeros((size, how.width), np.float32)
    head, bias = rng.normal(0, how.width ** -0.5, (how.width, 2)).astype(np.float32), 0.0
    past, past_head = np.full(size, 1e-16), 1e-8
    for k in range(how.rounds):
        rate = how.rate * (1 - k / how.rounds)
        across = head[:, 1] - head[:, 0]
        weights, at = (vectors @ across * telling).astype(np.float64), bias

        def errors(chunk: Chunk) -> np.ndarray:
            total = np.maximum(chunk.per_text(mass.astype(np.float64) if how.telling > 0 else None), 1e-9)
            z = chunk.per_text(weights) / total + at
            wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - chunk.label
            return np.append(chunk.per_bucket(np.rint(wrong / total / ERROR), size), np.rint(wrong / ERROR).sum()) * ERROR

        found = summed(errors, size + 1) / (n0 + n1)
        slope = found[:size] * telling
        moved = np.flatnonzero(slope)
        past[moved] += slope[moved] ** 2 * float((across ** 2).mean())
        own = slope[moved] @ vectors[moved]
        vectors[moved] -= (rate * slope[moved] / np.sqrt(past[moved])).astype(np.float32)[:, None] * across
        past_head += float((own ** 2).mean())
        head += (rate * own / np.sqrt(past_head)).astype(np.float32)[:, None] * np.array([1, -1], np.float32)
        bias -= 2 * rate * float(found[size])
    return Model(features, vectors @ (head[:, 1] - head[:, 0]) * telling, mass, bias)


class Scorer:
    """Adds up a model over texts; the numbers of words are kept from task to task."""

    def __init__(self, model: Model):
        self.model, self.words = model, WordTable(self._compute)

    def _compute(self, words: list[str]):
        own, numbers, buckets, weight = self.model.features.of_words(words)
        total = np.bincount(numbers, self.model.weights[buckets] * weight, len(words))
        return own, total, np.bincount(numbers, self.model.mass[buckets] * weight, len(words))

    def score(self, texts: list[str]) -> np.ndarray:
        features = self.model.features
        split = [features.words(t) for t in texts]
        at = self.words.index([w for words in split for w in words])
        of = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        if not len(at):
            return np.full(len(texts), 1 / (1 + np.exp(-self.model.bias)))
        total = np.bincount(of, self.words.column(1)[at], len(texts))
        count = np.bincount(of, self.words.column(2)[at], len(texts))
        if features.pairs and len(at) > 1:
            inside = of[:-1] == of[1:]
            buckets = features.of_pairs(self.words.column(0)[at])[inside]
            total += np.bincount(of[1:][inside], self.model.weights[buckets], len(texts))
            count += np.bincount(of[1:][inside], self.model.mass[buckets], len(texts))
        z = total / np.maximum(count, 1e-9) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


PARTS = 16  # blocks of buckets in which sums are added up over the tasks
ROW_CHARS = 4 << 20  # of text whose words share a row of the table: a word stands there once
ROWS = 16  # of the table that a task adds up at least, where all cores have some: each task sends as many sums on
MARKS = 1 << 23  # bits that mark hashed ids


def summed_over(chunks: DataFrame, features: Features) -> Sums:
    """Sums over the rows of a table of words; each task adds up its own."""
    chunks = chunks.coalesce(max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // ROWS)))

    def summed(each: Callable[[Chunk], np.ndarray], size: int) -> np.ndarray:
        width = -(-size // PARTS)

        def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, any_rows = np.zeros(PARTS * width), False
            for batch in batches:
                for row in range(batch.num_rows):
                    any_rows = True
                    columns = (np.frombuffer(batch.column(c)[row].as_buffer(), KINDS.get(c, np.int32)) for c in COLUMNS)
                    total[:size] += each(Chunk(*columns, features))
            if any_rows:
                yield told(dict(enumerate(total.reshape(PARTS, width))))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                    sums[block] = sums.get(block, 0) + np.frombuffer(part)
            yield told(sums)

        schema, out = "block int, sums binary", np.zeros((PARTS, width))
        parts = chunks.mapInArrow(tidy(run), schema).repartition(PARTS, "block")
        for row in parts.mapInArrow(tidy(merge), schema).collect():  # a number per bucket in all
            out[row["block"]] = np.frombuffer(row["sums"])
        return out.ravel()[:size]

    return summed


def perhaps_in(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``known`` and some whose id is not, by marked hashes of ids.

    Spares the texts of most other rows the way to a join; the marks are of fixed size.
    """
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(MARKS))
    bit = F.expr("shiftleft(1L, cast(mark % 64 as int))")
    marks = known.select(mark.alias("mark")).groupBy(F.expr("mark div 64").alias("block")).agg(F.bit_or(bit).alias("bits"))
    return docs.withColumn("mark", mark).withColumn("block", F.expr("mark div 64")).join(F.broadcast(marks), "block").where(
        F.col("bits").bitwiseAND(bit) != 0).select(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame, label: str, features: Features, how: Training) -> Model:
    """A model from all labelled documents.

    Their words are written as a table once, some documents in a row; each round of the
    descent adds up a number per bucket over it. Labels that are null, or whose document is
    missing, take no part. One label per document (the larger, should there be several).
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label"))
    rows = perhaps_in(docs.select("doc_id", text_of().alias("text")), known).join(known, "doc_id").select("text", "label")

    def told(texts: list[str], classes: list[int]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(features, texts, classes, how.most):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, classes, size = [], [], 0
        for batch in batches:
            for part, texts in text_slices(batch):
                waiting += texts
                classes += part.column("label").to_pylist()
                size += sum(map(len, texts))
                if len(waiting) >= how.most or size >= ROW_CHARS:
                    yield from told(waiting, classes)
                    waiting, classes, size = [], [], 0
        yield from told(waiting, classes)

    ship(docs.sparkSession)
    chunks = through_table(rows.mapInArrow(tidy(run), ", ".join(f"{c} binary" for c in COLUMNS)), "words")
    return descend(summed_over(chunks, features), features, how)


def score_rows(docs: DataFrame, model: Model, into: str, text: str = "text") -> DataFrame:
    """``docs`` with the score of class 1 in the column ``into``. One pass, no shuffle."""
    def make():
        scorer = held(model.name, lambda: Scorer(model))

        def run(batch: pa.RecordBatch):
            for part, texts in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(texts))], [*part.schema.names, into])
        return run

    return map_arrow(docs, make, docs.withColumn(into, F.lit(0.0)).schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return score_rows(rows, model, "score").select("doc_id", "score")
