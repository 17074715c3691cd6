"""Byte-level BPE encoding and decoding.

A piece of text is merged with a segment tree over its byte positions: leaf ``i`` holds
the rank of the pair that starts at ``i``, every inner node the smallest (rank, position)
below it, so the root is the leftmost pair of minimum rank. A merge changes at most three
leaves, each in logarithmic time. The trees of many pieces are rows of one array and take
their merges together; the merges of one piece stay in order.

Pieces are cached per task in a table of bounded size, as words repeat.

Defined results: a null text is the empty text and has no ids; ids of null decode to
null; text of any length is one row; repeated rows give repeated results; ``encode``
keeps the columns it is asked for.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import WordTable, held, map_arrow, ragged, text_of, text_slices

NONE = np.int64(1) << 24  # rank of a pair that is no token: above all ranks, and its product with a tree's width fits to 2^38
CELLS = 1 << 18  # tree nodes worked on together
DECODED = 1 << 17  # ids decoded together


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Tokens:
    """The bytes of every token in one array, which is all that decoding needs."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(table), np.uint8)


class Ranks:
    """The tokens of a rank file, and the rank of each pair of tokens that makes a token."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        known = self.ranks.get
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = known(token[:k]), known(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        # A last key that no pair has, so that every search ends inside the table.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        self.bytes = np.array([known(bytes([b]), -1) for b in range(256)], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_pieces(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and how many each has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    counts, held = np.zeros(len(pieces), np.int64), {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        step = max(1, CELLS // (2 * int(w)))
        for k in range(0, len(own), step):
            part = own[k:k + step]
            ids, n = _merge(ranks, [pieces[i] for i in part], lengths[part], int(w))
            counts[part] = n
            held[int(w), k] = part, ids
    out, starts = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
    for part, ids in held.values():
        out[ragged(starts[part], counts[part])] = ids
    return out, counts


def _merge(ranks: Ranks, pieces: list[bytes], lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(pieces)
    row = np.arange(m)
    there = np.arange(w)[None, :] < lengths[:, None]
    token = np.zeros((m, w), np.int64)
    token[there] = ranks.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.broadcast_to(np.arange(1, w + 1), (m, w)).copy()
    before = np.broadcast_to(np.arange(-1, w - 1), (m, w)).copy()
    tree = np.full((m, 2 * w), NONE * w, np.int64)
    first = there[:, 1:]
    tree[:, w:2 * w - 1][first] = (ranks.pair(token[:, :-1][first], token[:, 1:][first]) * w
                                   + np.broadcast_to(np.arange(w - 1), (m, w - 1))[first])
    level = w
    while level > 1:
        tree[:, level // 2:level] = tree[:, level:2 * level].reshape(m, level // 2, 2).min(2)
        level //= 2
    while True:
        row = row[tree[row, 1] < NONE * w]
        if not len(row):
            break
        rank, at = np.divmod(tree[row, 1], w)
        gone = after[row, at]
        follow = after[row, gone]
        token[row, at] = rank
        after[row, at] = follow
        there[row, gone] = False
        last = follow >= lengths[row]
        inner = ~last
        before[row[inner], follow[inner]] = at[inner]
        prior = before[row, at]
        new = np.full((len(row), 3), NONE, np.int64)
        new[inner, 1] = ranks.pair(rank[inner], token[row[inner], follow[inner]])
        has = prior >= 0
        new[has, 2] = ranks.pair(token[row[has], prior[has]], rank[has])
        # Without a pair before it, the leaf of the merged pair is written once more.
        leaf = np.stack([gone, at, np.where(has, prior, at)], 1)
        new[~has, 2] = new[~has, 1]
        lines = row[:, None]
        tree[lines, w + leaf] = np.where(new < NONE, new * w + leaf, NONE * w)
        node = (w + leaf) >> 1
        while node[0, 0]:
            tree[lines, node] = np.minimum(tree[lines, 2 * node], tree[lines, 2 * node + 1])
            node >>= 1
    return token[there], there.sum(1)


class Encoder:
    """Encodes texts by ranks, each match of ``pattern`` by itself."""

    # Next to other white space a space may belong to either side of it.
    _crowded = re.compile(r"[^\S ] |(?<= )[^\S ]")

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pieces = Ranks(path), regex.compile(pattern).findall
        self.chunks = WordTable(self._chunks, 100_000)
        self.merged = WordTable(self._merge, 80_000)
        # Ids of chunks and of pieces, one after another; columns say where each begins.
        self.ids = {self.chunks: np.empty(1 << 16, np.int64), self.merged: np.empty(1 << 16, np.int64)}

    def _append(self, table: WordTable, flat: np.ndarray, counts: np.ndarray):
        """Start and count of each new word whose ids stand in ``flat``."""
        n = table.done
        used = int(table.column(0)[n - 1] + table.column(1)[n - 1]) if n else 0
        if used + len(flat) > len(self.ids[table]):
            self.ids[table] = np.append(self.ids[table][:used], np.empty(used + 2 * len(flat), np.int64))
        self.ids[table][used:used + len(flat)] = flat
        return used + np.cumsum(counts) - counts, counts

    def _look_up(self, table: WordTable, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        at = table.index(words)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = table.column(1)[at]
        return self.ids[table][ragged(table.column(0)[at], counts)], counts

    def _chunks(self, chunks: list[str]):
        """A chunk of letters after a space is a piece, as is the mark that ends it."""
        per_chunk = []
        for c in chunks:
            if c[1:].isalpha() and c[0] == " ":
                per_chunk.append((c,))
            elif c[0] == " " and c[-1] in ".,;:!?" and c[1:-1].isalpha():
                per_chunk.append((c[:-1], c[-1]))
            else:
                per_chunk.append(self.pieces(c))
        ids, counts = self._look_up(self.merged, [p for found in per_chunk for p in found])
        edges = np.append(0, np.cumsum([len(x) for x in per_chunk]))
        return self._append(self.chunks, ids, np.diff(np.append(0, np.cumsum(counts))[edges]))

    def _merge(self, words: list[str]):
        pieces = [p.encode() for p in words]
        known = self.ranks.ranks.get
        ids = np.fromiter((known(p, -1) for p in pieces), np.int64, len(pieces))
        counts = np.ones(len(pieces), np.int64)
        rest = np.flatnonzero(ids < 0)
        merged, counts[rest] = merge_pieces(self.ranks, [pieces[i] for i in rest])
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        flat[starts[ids >= 0]] = ids[ids >= 0]
        flat[ragged(starts[rest], counts[rest])] = merged
        return self._append(self.merged, flat, counts)

    def _split(self, text: str) -> list[str]:
        if "  " in text or self._crowded.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        return [*([head] if head else []), *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        split = [self._split(t) for t in texts]
        ids, counts = self._look_up(self.chunks, [c for chunks in split for c in chunks])
        edges = np.append(0, np.cumsum([len(x) for x in split]))
        return ids, np.diff(np.append(0, np.cumsum(counts))[edges])


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the ids of each whole text, without special tokens. No shuffle."""
    rows = docs.select(*keep, text_of().alias("llm_text"))

    def make():
        encoder = held((path, pattern), lambda: Encoder(path, pattern))

        def run(batch: pa.RecordBatch):
            for part, texts in text_slices(batch, "llm_text"):
                ids, counts = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], [*keep, "ids"])
        return run

    return map_arrow(rows, make, rows.select(*keep, F.lit(None).cast("array<int>").alias("ids")).schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The other columns and the bytes that ``ids`` stand for. No shuffle."""
    others = [c for c in df.columns if c not in (ids, into)]
    schema = df.select(*others, F.lit(None).cast("binary").alias(into)).schema

    def make():
        tokens = held(("tokens", path), lambda: Tokens(path))

        def run(batch: pa.RecordBatch):
            column = batch.column(ids)
            sizes = np.asarray(column.value_lengths().fill_null(0))
            ends = np.cumsum(sizes)
            start = 0
            while start < len(sizes):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + DECODED, "right")))
                part = column.slice(start, stop - start)
                numbers = np.asarray(part.flatten()).astype(np.int64)
                lengths = tokens.lengths[numbers]
                blob = tokens.blob[ragged(tokens.starts[numbers], lengths)].tobytes()
                cuts = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes[start:stop]))]
                texts = [blob[a:b] if ok.as_py() else None
                         for a, b, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), part.is_valid())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in others), pa.array(texts, pa.binary())], [*others, into])
                start = stop
        return run

    return map_arrow(df.select(*others, ids), make, schema)
