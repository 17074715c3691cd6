"""Language identification by bit-sliced Bloom filters of n-grams.

A table has a row per hash value and a bit per language in every row. The n-grams of a
language set its bit in ``HASHES`` rows each; looking up an n-gram takes the same rows and
the bits they share, which are the languages that have it, all in one step. The bits of a
text's n-grams are counted by language. A filter that is full to the share ``f`` also
answers for ``f ** HASHES`` of the n-grams that the language does not have; each count is
corrected for that, and the language with the largest share of the text's n-grams is it.

A language has the n-grams, of two to four characters of a word between boundary marks and
whole short words, that enough of its documents contain, among about ``PER_LANGUAGE``
labelled documents of each language, or all if it has fewer, chosen by a hash of the id.
Nothing else is sampled.

Defined results: a null text, or one without a letter, is ``und`` with the score 0, as is
everything if no document has a label; a text whose n-grams no language has is the first
learned language by name, with the score 0; among equal shares the first by name decides;
repeated rows give repeated results; a null ``doc_id`` is not held out; extra columns are
not read. The score is the language's part of all corrected shares.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table
from .common import WordTable, held, map_arrow, ship, text_of, text_slices
from .quality import fold_of

PER_LANGUAGE = 2000  # labelled documents of a language that its filter is made from, on average where there are more
HASHES = 3
SHARE = 0.01  # of a language's documents that have an n-gram, for the filter to hold it
LEAST = 2  # documents at least
SHORTEST, LONGEST = 2, 4
MOST_ROWS = 1 << 22  # of the table; eight for each n-gram of the largest language below that
UNKNOWN = "und"

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and 64-bit hash of every n-gram of every word."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stop, of = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(words)), lengths)
    numbers, hashes, rolled = [], [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            rolled = rolled[:max(0, len(codes) - n + 1)] * np.uint64(1_000_003) + codes[n - 1:]
            if n < SHORTEST:
                continue
            inside = np.flatnonzero(np.arange(len(rolled)) + n <= stop[:len(rolled)])
            x = (rolled[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            numbers.append(of[inside])
            hashes.append(x ^ (x >> np.uint64(32)))
    return np.concatenate(numbers), np.concatenate(hashes)


def rows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The table's rows of each n-gram, ``HASHES`` of them."""
    with np.errstate(over="ignore"):
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return ((hashes[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step) % np.uint64(size)).astype(np.int64)


@dataclass
class Filters:
    """Languages and their bits: ``bits`` has ``size`` rows of a bit per language."""

    languages: list[str]
    bits: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        held_bits = np.unpackbits(self.bits, axis=1, count=len(self.languages)) if self.languages else np.zeros((1, 0))
        self.false = held_bits.mean(0) ** HASHES  # share of foreign n-grams that are answered for

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """A bit per n-gram and language: whether the language has the n-gram."""
        rows = rows_of(hashes, len(self.bits))
        shared = self.bits[rows[0]]
        for k in range(1, HASHES):
            shared = shared & self.bits[rows[k]]
        return np.unpackbits(shared, axis=1, count=len(self.languages))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, share: float = SHARE) -> Filters:
    """Filters of every language that ``docs`` (doc_id, text, lang) has.

    N-grams are counted by document and language where the texts lie, then added up; the
    rows they set reach the driver as bitmaps of the table, whose size is bounded.
    """
    spark = docs.sparkSession
    lang = F.col("lang").cast("string")
    known = docs.where("lang IS NOT NULL").select("doc_id", lang.alias("lang"), text_of().alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint8))
    number = {x: k for k, x in enumerate(languages)}
    # A share of each language by the hash of the id: no rows are ranked, joined or shuffled.
    share_of = F.element_at(F.create_map(*(F.lit(v) for x in languages for v in (x, min(1 << 30, (per_language << 30) // counts[x])))), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < share_of)
    sizes = {x: min(n, per_language) for x, n in counts.items()}

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for part, texts in text_slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), texts):
                    words = list(dict.fromkeys(words_of(text)))
                    if words:
                        found.update((number[lang], x) for x in np.unique(grams_of(words)[1].view(np.int64)).tolist())
            if len(found) > 1 << 18:
                yield told(found)
                found.clear()
        yield told(found)

    def told(found):
        langs, grams = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.int32()), pa.array(grams, pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    ship(spark)
    grams = chosen.select("lang", "text").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.element_at(F.array(*(F.lit(max(LEAST, share * sizes[x])) for x in languages)), F.col("lang") + 1)
    kept = through_table(grams.where(F.col("n") >= least).select("lang", "gram"), "grams")
    largest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = 1 << 15
    while size < min(MOST_ROWS, 8 * largest):
        size *= 2
    marked = np.zeros((len(languages), size), bool)

    def mark(batches):
        for batch in batches:
            at = rows_of(batch.column("gram").to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(batch.column("lang").to_numpy(), HASHES)), pa.array(at.ravel() + 1)], ["lang", "at"])

    bitmaps = kept.mapInArrow(mark, "lang int, at long").groupBy("lang", F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for row in bitmaps.toLocalIterator():  # size bits for each language
        _put(marked[row["lang"]], row["bucket"], row["bits"])
    return Filters(languages, np.packbits(marked.T, axis=1))


def _put(row: np.ndarray, bucket: int, bits: bytes) -> None:
    """Sets the rows of one bucket of a bitmap; buckets count from 1."""
    found = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    row[(bucket - 1) * (8 * len(bits)) + found] = True


class Judge:
    """Counts the bits of texts; what a word adds is kept from task to task."""

    def __init__(self, filters: Filters):
        self.filters, self.words = filters, WordTable(self._compute)

    def _compute(self, words: list[str]):
        of, hashes = grams_of(words)
        bits = self.filters.languages_of(hashes)
        starts = np.searchsorted(np.sort(of), np.arange(len(words)))
        order = np.argsort(of, kind="stable")
        return np.add.reduceat(bits[order].astype(np.int64), starts, axis=0), np.bincount(of, minlength=len(words))

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        filters = self.filters
        split = [words_of(t) for t in texts]
        out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = self.words.index([w for words in split for w in words])
        if not len(at) or not filters.languages:
            return out, scores
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        hits = np.add.reduceat(self.words.column(0)[at], starts, axis=0)
        total = np.add.reduceat(self.words.column(1)[at], starts)[:, None]
        shares = ((hits - total * filters.false) / (total * np.maximum(1 - filters.false, 1e-9))).clip(0, 1)
        best, sums = shares.argmax(1), shares.sum(1)
        for k, b in zip(some.tolist(), best.tolist()):
            out[k] = filters.languages[b]
        scores[some] = np.where(sums > 0, shares[np.arange(len(best)), best] / np.where(sums > 0, sums, 1), 0)
        return out, scores


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    def make():
        judge = held(filters.name, lambda: Judge(filters))

        def run(batch: pa.RecordBatch):
            for part, texts in text_slices(batch):
                found, scores = judge.judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(rows, make, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows outside fold 0 of 5 only."""
    held_out = F.coalesce(fold_of(5) == 0, F.lit(False))
    filters = learn(docs.where(~held_out).select("doc_id", "text", "lang"), per_language, share)
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
