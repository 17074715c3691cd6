import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tagloom.llm import bpe, catalog, tokencounts

from .plain import DATA, HARD, hard

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = [0, *counts.cumsum().tolist()]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_encoder_is_the_librarys(library):
    random.seed(1)
    marks = [*"abc '\n\t  \u0085\x1c\x1f日本é😀019.!'s", "  ", "'ll"]
    texts = ["", " ", "   a", "a  b \n c", "x" * 3000, "ab" * 2000]
    texts += ["".join(random.choices(marks, k=random.randint(0, 60))) for _ in range(1500)]
    assert encoded(bpe.Encoder(RANKS, public_tokenizers.PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


def test_tables_that_run_full_change_nothing(library):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    encoder.chunks.most = encoder.merged.most = 30
    for k in range(30):
        texts = [f"word{k} new{k}ish common {j} text" for j in range(20)]
        assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_keys_of_wide_trees_do_not_overflow():
    ranks = bpe.Ranks(RANKS)
    assert max(ranks.ranks.values()) < bpe.NONE
    for w in (1 << 23, 1 << 38):
        assert bpe.NONE * np.int64(w) > (int(bpe.NONE) - 1) * w + w - 1


def test_long_runs_are_merged():
    """A short piece in a tree as wide as a run of more than 4 MiB needs."""
    ranks = bpe.Ranks(RANKS)
    w = 1 << 23
    ids, counts = bpe._merge(ranks, [b"ab" * 40], np.array([80]), w)
    want, few = bpe._merge(ranks, [b"ab" * 40], np.array([80]), 128)
    assert ids.tolist() == want.tolist() and counts.tolist() == few.tolist() and len(ids) < 80


def test_round_trip(spark):
    docs = hard(spark)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in bpe.decode(coded, RANKS).collect())
    assert got == sorted((i or 0, (t or "").encode()) for i, t in HARD)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first()["decoded"] is None
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_op7_against_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    rows = catalog.QUERIES["op7_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op10_against_the_library(spark):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    for r in catalog.QUERIES["op10_token_counts"](spark, DATA).collect():
        text = texts.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(pieces.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert not texts


def test_counts_are_cached_by_content_and_tokenizer(spark, tmp_path):
    model, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    docs = hard(spark)
    first = tokencounts.count_tokens(docs, model, cache)
    assert first.count() == len(HARD)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in HARD})
    again = tokencounts.count_tokens(docs, model, cache)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert spark.read.parquet(cache).count() == stored.count()
    other = public_tokenizers.path("byte_bpe_50k.json")
    tokencounts.count_tokens(docs, other, cache).collect()
    assert spark.read.parquet(cache).count() == 2 * stored.count()
    assert tokencounts.count_tokens(docs.limit(0), model, str(tmp_path / "none")).count() == 0
