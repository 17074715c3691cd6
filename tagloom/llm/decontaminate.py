"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages, each a TF-IDF vector; document frequencies are
counted over all documents, by hashed words, in one pass. Candidates come from two cosine
searches over all passages of all documents:

- in a latent space: a randomised SVD of the passages of all items and of all documents,
  whose sums over the matrix are added up over Spark's partitions, keeps ``RANK``
  directions, in which words that are used alike lie close, so that a paraphrase in
  other words stays near its item. Passages are folded in, and those whose cosine with an
  item's passage reaches ``LATENT`` are candidates;
- of the vectors themselves, exactly: a passage whose cosine with an item's passage reaches
  ``CANDIDATE`` is one. A word counts as often as the item's passage has it at most, and a
  passage that weighs more than the item's counts as heavy as that, so the score is one at
  least where the item's words all stand, whatever else the passage holds and however large
  the corpus is. No passage can reach the threshold without one of the item's rarest words,
  so only passages that have one are compared.

A candidate leaks if the longest common subsequence of words with the item covers enough
of it, or, for paraphrases, somewhat less of it but with the item's answer (its last
sentence) word for word.

Items are cut into passages of ``PIECE`` words at most, so that an item's length does not
dilute it; an item is a candidate where one of its passages is, and is verified whole.

One pass over the documents searches ``PASSAGES`` passages of items; what a task or the
driver holds is bounded by that number, or by one item if that is larger.

Defined results: null and empty texts leak nothing; items that are null or have no words
leak into nothing; items shorter than ``SHORT`` words must occur word for word; items that
repeat an id with another text are all searched, under that id; repeated rows give one
result per pair of ids; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table
from .common import distinct, held, map_arrow, ragged, ship, text_of, text_slices, tidy

PASSAGES = 1 << 16  # of items, searched in one pass over the documents
WINDOW, STRIDE = 32, 16  # words of a document's passage, and between the starts of two
PIECE = WINDOW - STRIDE + 1  # words of an item's passage at most: any so many lie whole in one of a document's
CANDIDATE, LATENT = 0.2, 0.85  # scores of the exact and the latent search
ALIKE = 0.4  # share of an item's passage whose words a latent candidate has
COVERED, WITH_ANSWER = 0.7, 0.5  # share of the item's words in common order
SHORT = 8
MARKS = 8  # numbers of 64 bits that mark a passage's words
BUCKETS = 1 << 18  # hashed words whose documents are counted
LATENT_WORDS, RANK = 1 << 14, 24  # hashed words of the latent space, and its directions
SKETCH = 2 * RANK  # random sums of passages that the latent space starts from
PARTS = 16  # blocks of terms in which sums over the passages are added up

_BREAK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BREAK).split()


_TO = np.frombuffer(_BREAK, np.uint8)
# Powers of an odd number and of its inverse, modulo 2 ** 64, for hashes of words by place.
BASE, CHUNK = 0x9E3779B97F4A7C15, 1 << 20
with np.errstate(over="ignore"):
    _POWERS, _INVERSES = (np.cumprod(np.append(np.uint64(1), np.full(CHUNK, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))


def _hashes(folded: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes, from running sums of bytes times powers of their place."""
    before, after = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    carry, power, inverse = np.uint64(0), np.uint64(1), np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(0, len(folded), CHUNK):
            part = folded[c:c + CHUNK].astype(np.uint64)
            sums = np.append(carry, np.cumsum(part * (_POWERS[:len(part)] * power)) + carry)  # up to each place
            a, b = np.searchsorted(starts, (c, c + len(part)))
            before[a:b] = sums[starts[a:b] - c]
            out[a:b] = _INVERSES[starts[a:b] - c] * inverse
            a, b = np.searchsorted(stops, (c, c + len(part)), "right")
            after[a:b] = sums[stops[a:b] - c]
            carry, power, inverse = sums[-1], power * _POWERS[CHUNK], inverse * _INVERSES[CHUNK]
        out *= after - before
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@dataclass
class Words:
    """The words of some texts, one after another, as numbers."""

    hashes: np.ndarray
    sizes: np.ndarray  # words of each text
    folded: np.ndarray  # bytes of all texts, with blanks between words and texts
    ends: np.ndarray  # of the texts in ``folded``

    def of(self, text: int) -> list[bytes]:
        return self.folded[self.ends[text - 1] if text else 0:self.ends[text]].tobytes().split()


class Text(Sequence):
    """The words of one of the texts, made when the first is asked for, and the numbers of those that items have."""

    def __init__(self, split: Words, text: int, terms: np.ndarray):
        self.split, self.text, self.terms = split, text, terms

    @cached_property
    def words(self) -> list[bytes]:
        return self.split.of(self.text)

    def __getitem__(self, where):
        return self.words[where]

    def __len__(self) -> int:
        return len(self.terms)


def split_words(texts: list[str]) -> Words:
    """As ``words_of`` on each, without a Python object per word."""
    own = [t.lower().encode() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    folded = _TO[np.frombuffer(b" ".join([*own, b""]), np.uint8)]
    turns = np.flatnonzero(np.diff((folded != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, stops = turns[::2], turns[1::2]
    return Words(_hashes(folded, starts, stops), np.diff(np.searchsorted(starts, ends), prepend=0), folded, ends)


def hashes_of(words) -> np.ndarray:
    """Hash of each word of a list."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    return _hashes(np.frombuffer(b" ".join(words), np.uint8), stops - lengths, stops)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)


def buckets_of(words) -> np.ndarray:
    return buckets(hashes_of(words))


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Longest common subsequence, a bit per word of ``a``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def contains(words: list[bytes], part: list[bytes]) -> bool:
    return b" " + b" ".join(part) + b" " in b" " + b" ".join(words) + b" "


@dataclass
class Corpus:
    """What the search knows of all documents: weights of hashed words, and their latent factors."""

    idf: np.ndarray  # per bucket
    factors: np.ndarray  # LATENT_WORDS x RANK

    def latent(self, buckets: np.ndarray) -> np.ndarray:
        return self.factors[buckets & (LATENT_WORDS - 1)] * self.idf[buckets, None]


@dataclass
class Items:
    """Items with their passages; small enough for every task."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    corpus: Corpus
    of: np.ndarray  # item number of each passage
    terms: np.ndarray  # passages x PIECE: distinct terms, -2 where there are fewer
    counts: np.ndarray  # and how often each stands
    idf: np.ndarray  # of each term
    latent: np.ndarray  # passages x RANK, unit vectors
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


HASHED = "codes binary, sizes binary, bucket array<int>, n array<long>"


def counted(bucket: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each passage, ascending, how often each stands, and how many there are of each passage.

    Passages lie one after another, ``WINDOW`` words each at most: each is sorted by itself.
    """
    firsts = np.cumsum(lengths) - lengths
    rows = np.full((len(lengths), WINDOW), BUCKETS, np.int32)
    inside = np.arange(WINDOW) < lengths[:, None]
    rows[inside] = bucket
    rows.sort(axis=1)
    bucket = rows[inside]
    new = np.append(True, bucket[1:] != bucket[:-1])
    new[firsts] = True
    starts = np.flatnonzero(new)
    return bucket[starts], np.diff(starts, append=len(bucket)), np.add.reduceat(new, firsts, dtype=np.int64)


def hashed_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All passages of all documents and items, and how many documents have a word of each bucket.

    Rows hold passages one after another: ``sizes`` distinct words of each, ``codes`` their
    buckets and, above these bits, how often each stands, as 32-bit numbers. A document's passages are ``WINDOW``
    words each and follow one another; items are cut as by ``pieces_of``. The last row of a task
    has its counts (``bucket``, ``n``) instead, those of bucket -1 being of documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part, texts in text_slices(batch):
                words, item = split_words(texts), part.column("item").to_numpy(zero_copy_only=False).astype(bool)
                n = words.sizes
                many = np.where(item, -(-n // PIECE), -(-n // WINDOW))
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
                own = np.where(item[of], ((place + 1) * many[of] - 1) // np.maximum(n[of], 1), place // WINDOW)
                passage = (np.cumsum(many) - many)[of] + own
                rows += int((~item).sum())
                if not len(of):
                    continue
                lengths = np.bincount(passage)
                bucket, times, sizes = counted(buckets(words.hashes), lengths)
                of = np.repeat(np.repeat(np.arange(len(n)), many), sizes)
                kind = np.int32 if len(n) * BUCKETS < 1 << 31 else np.int64  # narrow numbers are sorted faster
                had = distinct((of.astype(kind) * kind(BUCKETS) + bucket)[~item[of]])
                counts += np.bincount(had & (BUCKETS - 1), minlength=BUCKETS)
                yield told((bucket | times * BUCKETS).astype(np.int32).tobytes(), sizes.astype(np.int32).tobytes(), None, None)
        some = np.flatnonzero(counts)
        yield told(None, None, np.append(some, -1), np.append(counts[some], rows))

    def told(*columns):
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(columns, kinds)], ["codes", "sizes", "bucket", "n"])

    ship(docs.sparkSession)
    texts = docs.select(text_of().alias("text"), F.lit(False).alias("item")).union(items.select(text_of().alias("text"), F.lit(True).alias("item")))
    return through_table(texts.mapInArrow(tidy(run), HASHED), "passages")


def document_frequencies(passages: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have a word of each bucket, and documents, over the whole table."""
    pairs = passages.where("bucket IS NOT NULL").select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).select("x.bucket", "x.n")
    found = pairs.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS)
    at, many = (found.column(c).to_numpy() for c in ("bucket", "n"))
    df[at[at >= 0]] = many[at >= 0]
    return df, int(many[at < 0].sum())


def summed(passages: DataFrame, idf: np.ndarray, size: int, add: Callable[..., None]) -> np.ndarray:
    """An array that ``add(total, at, x, firsts, sizes)`` adds to, summed over all passages.

    ``at`` and ``x`` are the hashed terms of some passages and their weights, rows of length
    one; ``firsts`` and ``sizes`` tell the passages apart. Each task sums up its passages;
    blocks of the array are added up over the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            for codes, sizes in zip(batch.column("codes"), batch.column("sizes")):
                any_rows = True
                codes, sizes = (np.frombuffer(x.as_buffer(), np.int32) for x in (codes, sizes))
                ends = np.cumsum(sizes)
                first = 0
                while first < len(sizes):  # some ten thousand words at a time, whole passages
                    start = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, start + 65_536, "right")))
                    weigh(total, codes[start:ends[last - 1]], sizes[first:last])
                    first = last
        if any_rows:
            blocks = total.reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "sums"])

    def weigh(total: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        bucket = codes & (BUCKETS - 1)
        x = (codes // BUCKETS).astype(np.float32) * idf[bucket]
        firsts = np.cumsum(sizes) - sizes
        x /= np.repeat(np.sqrt(np.add.reduceat(x * x, firsts)), sizes)
        add(total, (bucket & (LATENT_WORDS - 1)).astype(np.int64), x, firsts, sizes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    ship(passages.sparkSession)
    schema = "block int, sums binary"
    parts = passages.where("codes IS NOT NULL").select("codes", "sizes").mapInArrow(tidy(run), schema)
    out = np.zeros((PARTS, size // PARTS))
    for row in parts.repartition(PARTS, "block").mapInArrow(tidy(merge), schema).collect():  # the array in all
        out[row["block"]] = np.frombuffer(row["sums"])
    return out.ravel()


def product(passages: DataFrame, idf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A'(A m) for the matrix A of all passages, rows of length one; a column of ``m`` at a time."""
    columns = np.ascontiguousarray(m.T, np.float32)

    def add(total: np.ndarray, at: np.ndarray, x: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> None:
        for own, column in zip(total.reshape(columns.shape), columns):
            seen = column.take(at, mode="clip")  # none is outside
            seen *= x
            back = np.repeat(np.add.reduceat(seen, firsts), sizes)
            back *= x
            own += np.bincount(at, back, len(column))

    return summed(passages, idf, m.size, add).reshape(columns.shape).T


def sketch(passages: DataFrame, idf: np.ndarray, terms: int, rows: int) -> np.ndarray:
    """Random sums (terms x rows) of all passages: each counts in one of them, with one sign, both by its hash."""
    def add(total: np.ndarray, at: np.ndarray, x: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            own = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
            own = np.add.reduceat((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), firsts)
        row = ((own >> np.uint64(40)) % np.uint64(rows)).astype(np.int64)
        sign = np.where(own >> np.uint64(39) & np.uint64(1), np.float32(1), np.float32(-1))
        total += np.bincount(np.repeat(row * terms, sizes) + at, np.repeat(sign, sizes) * x, len(total))

    return summed(passages, idf, rows * terms, add).reshape(rows, terms).T


def randomised_svd(passages: DataFrame, idf: np.ndarray, terms: int, rank: int, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """Right singular vectors (terms x rank) of the matrix of all passages.

    A block Krylov space: it begins at the best directions of random sums of passages, each
    round multiplies the last block, and the vectors are those of the Nystroem approximation
    from all blocks together, for which the products at hand suffice. The driver
    orthogonalises matrices of terms x rank.
    """
    rank = min(rank, terms)
    rows = sketch(passages, idf, terms, SKETCH)
    # A little of random directions, for those that few passages leave open.
    length = max(np.linalg.norm(rows), 1e-300)
    best = np.linalg.svd(rows / length, full_matrices=False)[0][:, :rank]
    q = np.linalg.qr(best + 1e-3 * np.random.default_rng(seed).normal(size=(terms, rank)) / np.sqrt(terms))[0]
    bases, images = [], []
    for _ in range(rounds):
        y = product(passages, idf, q)
        bases.append(q)
        images.append(y)
        space = np.hstack(bases)
        q = np.linalg.qr(y - space @ (space.T @ y))[0]
        q = np.linalg.qr(q - space @ (space.T @ q))[0]  # once more, against rounding
    images = np.hstack(images)
    small = space.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    some = values > 1e-6 * max(values.max(initial=0), 1e-300)
    found, sizes, _ = np.linalg.svd(images @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)
    return found[:, :rank][:, sizes[:rank] ** 2 > 1e-6 * max(sizes.max(initial=0) ** 2, 1e-300)]


def pieces_of(words: list[bytes]) -> list[list[bytes]]:
    """Passages of about equal length, ``PIECE`` words at most, that hold every word once."""
    many = -(-len(words) // PIECE)
    return [words[k * len(words) // many:(k + 1) * len(words) // many] for k in range(many)]


def fit(docs: DataFrame, items: DataFrame) -> Corpus:
    """Weights from all documents; the latent space from all passages of them and of the items."""
    passages = hashed_passages(docs, items)
    df, total = document_frequencies(passages)
    idf = (np.log((total + 2) / (np.minimum(df, total) + 1)) + 0.01).astype(np.float32)
    return Corpus(idf, randomised_svd(passages, idf, LATENT_WORDS, RANK).astype(np.float32))


def prepare(corpus: Corpus, rows: list) -> Items:
    """Terms, weights and latent vectors of (item_id, words, text)."""
    vocabulary: dict[bytes, int] = {}
    for _, words, _ in rows:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    pieces = [(i, piece) for i, (_, words, _) in enumerate(rows) for piece in pieces_of(words)]
    terms, counts = np.full((len(pieces), PIECE), -2, np.int32), np.zeros((len(pieces), PIECE), np.int32)
    latent = np.zeros((len(pieces), corpus.factors.shape[1]), np.float32)
    for k, (_, piece) in enumerate(pieces):
        count = Counter(vocabulary[w] for w in piece)
        terms[k, :len(count)], counts[k, :len(count)] = list(count), list(count.values())
        latent[k] = corpus.latent(buckets_of(piece)).sum(0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    answers = []
    for _, words, text in rows:
        last = [words_of(x) for x in text.replace("\n", ". ").split(". ")]
        last = [x for x in last if len(x) >= 3]
        answers.append(last[-1] if last else words)
    return Items([i for i, _, _ in rows], [w for _, w, _ in rows], answers, vocabulary, corpus, np.array([i for i, _ in pieces], np.int64),
                 terms, counts, corpus.idf[buckets_of(vocabulary)], latent)


class Postings:
    """Of each term the passages in which it counts, and how much of such a passage's weight
    the term and the more common ones make together.

    A passage of a document that has only terms whose part is less than some share cannot
    reach that share. Parts below ``least`` are left out.
    """

    def __init__(self, items: Items, energy: np.ndarray, least: float):
        rarity = np.where(items.terms >= 0, items.idf[items.terms], -1)
        order = np.argsort(-rarity, 1, kind="stable")
        falling = np.take_along_axis(energy, order, 1)
        rest = falling[:, ::-1].cumsum(1)[:, ::-1] / energy.sum(1, keepdims=True)
        part = np.zeros(energy.shape)
        np.put_along_axis(part, order, np.where(falling > 0, rest, 0), 1)
        passage, column = np.nonzero(part >= least)
        term = items.terms[passage, column]
        by = np.argsort(term, kind="stable")
        self.passages, self.parts = passage[by], part[passage, column][by]
        self.many = np.bincount(term, minlength=len(items.idf) + 1)  # the last for words that no item has
        self.first = np.cumsum(self.many) - self.many

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, passage, part) of every passage in which the term at a place counts."""
        some = np.flatnonzero(self.many[term])
        many = self.many[term[some]]
        found = ragged(self.first[term[some]], many)
        return np.repeat(some, many), self.passages[found], self.parts[found]


class Searcher:
    """Finds the items that leak into texts; word numbers are kept from task to task."""

    def __init__(self, items: Items):
        self.items = items
        idf = np.where(items.terms >= 0, items.idf[items.terms], 0).astype(np.float64)
        energy = (items.counts * idf) ** 2
        self.norms = np.sqrt(energy.sum(1))
        self.adds = items.counts * idf ** 2 / self.norms[:, None]  # of each time that a word stands
        self.lengths = items.counts.sum(1)
        # A passage lighter than the item's can have the cosine with the square of that share of the item's weight.
        self.postings = Postings(items, energy, CANDIDATE ** 2)
        # Marks of the terms, the last row for words that no item has: a first look at the words in common.
        bit = np.arange(len(items.idf) + 1) % (64 * MARKS)
        self.bits = np.zeros((len(bit), MARKS), np.uint64)
        self.bits[np.arange(len(bit)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
        self.bits[-1] = 0
        self.marks = np.bitwise_or.reduce(np.where(items.terms[:, :, None] >= 0, self.bits[items.terms], np.uint64(0)), axis=1)
        self.marked = np.bitwise_count(self.marks).sum(1)
        self.energy = items.corpus.idf.astype(np.float64) ** 2
        self.factors = np.ascontiguousarray(items.corpus.factors.T)
        hashes = hashes_of(items.vocabulary)
        self.numbers = np.argsort(hashes)
        self.known = hashes[self.numbers]
        # Of words in order of their buckets: where a bucket's begin, their hashes and numbers. Few buckets have several.
        order = np.argsort(buckets(hashes), kind="stable")
        self.own = np.append(hashes[order], np.uint64(0))
        # By columns and narrow, so that many passages are compared at once.
        kind = np.int16 if len(items.idf) < 1 << 15 else np.int32
        self.wanted = np.ascontiguousarray(items.terms.T, kind)
        self.number = np.append(order, -1).astype(kind)
        many = np.bincount(buckets(hashes), minlength=BUCKETS)
        self.begin = np.where(many > 0, np.cumsum(many) - many, len(hashes)).astype(np.int32)
        self.several = many > 1
        needs = [Counter(items.vocabulary[w] for w in words) for words in items.words]
        self.needs = [(np.fromiter(x, np.int64, len(x)), np.fromiter(x.values(), float, len(x))) for x in needs]
        self.stands = np.zeros(len(items.idf) + 1)  # 1 for words that stand in a part, the last for those that no item has

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, float, bool]]]:
        """Of each text: item number -> score, share covered, answer found."""
        split = split_words(texts)
        at, sizes = split.hashes, split.sizes
        out: list[dict] = [{} for _ in texts]
        if not len(at):
            return out
        bucket = buckets(at)
        term = self._terms(at, bucket)
        begins = np.cumsum(sizes) - sizes
        many = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
        of = np.repeat(np.arange(len(texts)), many)
        firsts = np.cumsum(many) - many
        start = begins[of] + (np.arange(len(of)) - firsts[of]) * STRIDE
        stop = np.minimum(start + WINDOW, begins[of] + sizes[of])
        near: list[dict] = [{} for _ in texts]
        found = [self._exact(at, term, bucket, sizes, begins, many, firsts, start, stop),
                 self._latent(term, bucket, sizes, begins, many, of, firsts, start, stop)]
        for window, passage, score in found:
            for k, p, s in zip(window.tolist(), passage.tolist(), score.tolist()):
                text = of[k]
                places, first = near[text].setdefault(int(self.items.of[p]), {}), int(start[k] - begins[text])
                places[first] = max(s, places.get(first, 0.0))
        for text, items in enumerate(near):
            words = Text(split, text, term[begins[text]:begins[text] + sizes[text]])
            for i, places in items.items():
                self._verify(words, i, places, out[text])
        return out

    def _terms(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Number of each word by its hash, -1 for those that no item has."""
        first = self.begin[bucket]
        term = np.where(self.own[first] == at, self.number[first], self.number[-1])
        rest = np.flatnonzero(self.several[bucket])
        near_by = np.minimum(np.searchsorted(self.known, at[rest]), len(self.known) - 1)
        term[rest] = np.where(self.known[near_by] == at[rest], self.numbers[near_by], -1)
        return term

    def _exact(self, at, term, bucket, sizes, begins, many, firsts, start, stop):
        """(passage of a document, of an item, cosine) where the score reaches its threshold."""
        summed = np.append(0, np.cumsum(self.energy[bucket]))
        # Equal words count apart here, which can only lower the norm.
        light = np.sqrt(summed[stop] - summed[start])
        place, passage, part = self.postings.of(term)
        doc = np.searchsorted(begins + sizes, place, "right")
        block, keys = (place - begins[doc]) // STRIDE, []
        for back in (0, 1):  # the passages of the document that a word lies in
            k = block - back
            inside = np.flatnonzero((k >= 0) & (k < many[doc]))
            window = firsts[doc[inside]] + k[inside]
            own = passage[inside]
            # The part of the item's passage that the score asks for: less of it where the document's is lighter.
            able = part[inside] >= CANDIDATE * np.minimum(1, light[window] / self.norms[own]) - 1e-9
            keys.append(window[able] * len(self.norms) + own[able])
        keys = distinct(np.concatenate(keys))
        windows, passages, scores = [], [], []
        for c in range(0, len(keys), 4096):
            window, passage = np.divmod(keys[c:c + 4096], len(self.norms))
            place, outside, times = self._common(term, start, stop, window, passage)
            product = (times * self.adds[passage]).sum(1)
            able = np.flatnonzero(product >= CANDIDATE * np.minimum(light[window], self.norms[passage]) - 1e-9)
            window, passage, product = window[able], passage[able], product[able]
            whole = self._norms(at, bucket, place[able], outside[able])
            good = product >= CANDIDATE * np.minimum(whole, self.norms[passage])
            windows.append(window[good])
            passages.append(passage[good])
            scores.append(product[good] / whole[good])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([e, *x]) for e, x in ((none, windows), (none, passages), (np.zeros(0), scores)))

    def _common(self, term, start, stop, window, passage):
        """Places of the words of a document's passages, which lie outside, and how often each term of the
        item's passage stands there, as often as it has it at most."""
        place = start[window] + np.arange(WINDOW)[:, None]
        outside = place >= stop[window]
        here = term.take(place, mode="clip")
        here[outside] = -1
        wanted = self.wanted.take(passage, axis=1)
        times, equal = np.zeros(wanted.shape, np.uint8), np.empty(wanted.shape, bool)
        for own in here:
            times += np.equal(own, wanted, out=equal).view(np.uint8)
        return place.T, outside.T, np.minimum(np.ascontiguousarray(times.T), self.items.counts[passage])

    def _norms(self, at, bucket, place, outside) -> np.ndarray:
        """Norms of passages, each a row of places of words."""
        place = np.minimum(place, len(at) - 1)
        number, energy = np.where(outside, np.uint64(0), at[place]), np.where(outside, 0, self.energy[bucket[place]])
        order = np.argsort(number, 1, kind="stable")
        number, energy = np.take_along_axis(number, order, 1), np.take_along_axis(energy, order, 1)
        new = np.ones(number.shape, bool)
        new[:, 1:] = number[:, 1:] != number[:, :-1]
        run = (np.cumsum(new) - 1).reshape(number.shape)
        times = np.bincount(run.ravel())[run]  # a word's weight counts by its square
        return np.sqrt(np.maximum((energy * times).sum(1), 1e-12))

    def _latent(self, term, bucket, sizes, begins, many, of, firsts, start, stop):
        """(passage of a document, of an item, cosine) where the latent cosine reaches its threshold.

        Of the passage's words ``ALIKE`` at least must be the item's: others cannot be verified.
        """
        blocks = -(-sizes // STRIDE)
        first_block = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(sizes)), blocks)
        edge = begins[doc] + (np.arange(len(doc)) - first_block[doc]) * STRIDE
        sums = np.empty((len(edge) + 1, self.items.latent.shape[1]), np.float32)
        marks = np.zeros((len(edge) + 1, MARKS), np.uint64)
        sums[-1] = 0
        for c in range(0, len(edge), 4096):
            own = edge[c:c + 4096]
            end = edge[c + 4096] if c + 4096 < len(edge) else len(bucket)
            at, idf = bucket[own[0]:end].astype(np.int64) & (LATENT_WORDS - 1), self.items.corpus.idf[bucket[own[0]:end]]
            for column, factor in zip(sums.T, self.factors):
                weights = factor[at]
                weights *= idf
                column[c:c + len(own)] = np.add.reduceat(weights, own - own[0])
            marks[c:c + len(own)] = np.bitwise_or.reduceat(self.bits[term[own[0]:end]], own - own[0], axis=0)
        left = first_block[of] + np.arange(len(of)) - firsts[of]
        right = np.where(left + 1 < first_block[of] + blocks[of], left + 1, len(edge))
        step = max(64, (1 << 21) // len(self.norms))
        windows, passages, scores = [], [], []
        for c in range(0, len(of), step):
            x = sums[left[c:c + step]] + sums[right[c:c + step]]
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            cosine = x @ self.items.latent.T
            hits = np.flatnonzero(cosine >= LATENT)
            window, passage = np.divmod(hits, cosine.shape[1])
            score = cosine.ravel()[hits].astype(np.float64)
            own = marks[left[c:c + step]] | marks[right[c:c + step]]
            some = [np.flatnonzero(np.bitwise_count(own[window[k:k + 65_536]] & self.marks[passage[k:k + 65_536]]).sum(1)
                                   >= ALIKE * self.marked[passage[k:k + 65_536]]) + k for k in range(0, len(window), 65_536)]
            some = np.concatenate([np.zeros(0, np.int64), *some])
            window, passage, score = window[some], passage[some], score[some]
            for k in range(0, len(window), 4096):
                w, p = window[k:k + 4096] + c, passage[k:k + 4096]
                alike = np.flatnonzero(self._common(term, start, stop, w, p)[2].sum(1) >= ALIKE * self.lengths[p])
                windows.append(w[alike])
                passages.append(p[alike])
                scores.append(score[k:k + 4096][alike])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([e, *x]) for e, x in ((none, windows), (none, passages), (np.zeros(0), scores)))

    def _verify(self, words: Text, i: int, places: dict[int, float], found: dict) -> None:
        """Whether item ``i`` leaks around one of the passages that begin at ``places``.

        Passages that begin within a quarter of the item's length are verified together.
        """
        item, answer = self.items.words[i], self.items.answers[i]
        needed, times = self.needs[i]
        share = WITH_ANSWER if len(item) >= SHORT else 1
        starts = sorted(places)
        k = 0
        while k < len(starts):
            first = last = k
            while last + 1 < len(starts) and starts[last + 1] - starts[first] <= len(item) // 4:
                last += 1
            k = last + 1
            where = slice(max(0, starts[first] - len(item)), starts[last] + WINDOW + len(item))
            here = words.terms[where]
            self.stands[here] = 1
            most = times.dot(self.stands[needed])
            self.stands[here] = 0
            if most < share * len(item):  # no subsequence is longer
                continue
            part = words[where]
            covered = common_length(item, part) / len(item)
            if len(item) < SHORT:
                answered, leaks = True, contains(part, item)
            else:
                answered = covered >= WITH_ANSWER and contains(part, answer)
                leaks = covered >= COVERED or answered
            if leaks:
                score = max(places[s] for s in starts[first:last + 1])
                had = found.get(i, (0.0, 0.0, False))
                found[i] = max(score, had[0]), max(covered, had[1]), answered or had[2]


def blocks(docs: DataFrame, benchmark: DataFrame, size: int = PASSAGES) -> Iterator[Items]:
    """The benchmark in order of ids and texts, about ``size`` passages at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    last, corpus = None, None
    while True:
        rest = items if last is None else items.where(
            (F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > F.lit(last[1]))))
        rows = [(r["item_id"], r["text"]) for r in rest.orderBy("item_id", "text").limit(size).collect()]
        taken, pieces = [], 0
        for row in rows:
            words = words_of(row[1])
            own = -(-len(words) // PIECE)
            if taken and pieces + own > size:
                break
            taken.append((row[0], words, row[1]))
            pieces += own
        kept = [x for x in taken if x[1]]
        if kept:
            corpus = corpus or fit(docs, items)
            yield prepare(corpus, kept)
        if len(taken) == len(rows) < size:
            return
        last = taken[-1][0], taken[-1][2]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = PASSAGES) -> DataFrame:
    """doc_id, item_id, cosine, covered, answer of every document and item that leaks into it."""
    schema = "doc_id long, item_id long, cosine double, covered double, answer boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(docs, benchmark, size):
        def make(items=items):
            searcher = held(items.name, lambda: Searcher(items))

            def run(batch: pa.RecordBatch):
                hits = []
                for part, texts in text_slices(batch):
                    for own, found in zip(part.column("doc_id").to_pylist(), searcher.search(texts)):
                        hits += [(own, items.ids[i], *x) for i, x in found.items()]
                columns = list(zip(*hits)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["doc_id", "item_id", "cosine", "covered", "answer"])
            return run
        out = out.union(map_arrow(rows, make, schema))
    return out.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("covered").alias("covered"), F.max("answer").alias("answer"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, size: int = PASSAGES) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with their columns. No shuffle of texts."""
    kept = docs
    for items in blocks(docs, benchmark, size):
        def make(items=items):
            searcher = held(items.name, lambda: Searcher(items))

            def run(batch: pa.RecordBatch):
                for part, texts in text_slices(batch):
                    yield part.filter(pa.array([not found for found in searcher.search(texts)], pa.bool_()))
            return run
        kept = map_arrow(kept, make, kept.schema)
    return kept
