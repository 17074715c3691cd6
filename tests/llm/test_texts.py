import math
import random
import re
import time
from collections import Counter

import numpy as np

from tagloom.llm import catalog, decontaminate, licenses

from .plain import DATA, HARD, hard, lower_ascii


def test_op8_base_against_plain(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    rows = catalog.QUERIES["op8_license_scan"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(texts[r["doc_id"]]))
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        places = sorted(k for k, _ in at)
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def labels(text):
    words = text.encode().translate(licenses._FOLD).split()
    return {licenses.RULES[n].label for n, _, _ in licenses.detect(b" " + b" ".join(words) + b" ")}


def test_rules_priority_and_containment():
    assert len(licenses.RULES) > 200
    assert labels("GNU Lesser General Public License, version 2.1") == {"lgpl-2-1"}
    assert labels("under the terms of the GNU General Public License v3") >= {"gpl-3"}
    assert labels("Licensed under the Apache License, Version 2.0") >= {"apache-2-0"}
    assert labels("SPDX-License-Identifier: MPL-2.0") == {"mpl-2-0"}
    assert labels("Creative Commons Attribution-ShareAlike 4.0 International") == {"cc-by-sa-4-0"}
    assert labels("CC BY-NC 4.0") == {"cc-by-nc-4-0"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == {"mit"}
    assert labels("a text about a limited licence to kill, apache dances and mozilla") == set()


def test_versions_before_names_and_bare_names():
    assert labels("GPL-2.0-or-later") >= {"gpl-2-0"} and labels("version 2 of the GNU General Public License") >= {"gpl-2"}
    assert labels("Apache 2.0") >= {"apache-2-0"} and labels("python 2 and php 3") == set()


def test_many_phrases_in_one_text_take_seconds(spark):
    began = time.monotonic()
    docs = spark.createDataFrame([(1, "mit license " * 200_000)], "doc_id long, text string")
    row = licenses.scan_licenses(docs).select("n_words", "n_base", "first_word", "last_word").first()
    assert tuple(row) == (400_000, 200_000, 0, 399_998) and time.monotonic() - began < 60


def test_license_scan_of_hard_rows(spark):
    rows = licenses.scan_licenses(hard(spark)).collect()
    assert len(rows) == len(HARD)
    assert {(r["n_words"], r["labels"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, "", 0.0)}
    assert licenses.scan_licenses(hard(spark).limit(0)).count() == 0


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_subsequence_length_against_plain():
    random.seed(2)
    for _ in range(300):
        a, b = (random.choices("abcd", k=random.randint(1, 40)) for _ in range(2))
        assert decontaminate.common_length(a, b) == plain_length(a, b)


def test_leaks_verbatim_edited_and_answered(spark):
    random.seed(9)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(4000)]
    item = lambda n: random.choices(words, k=n)
    items = [item(random.randint(15, 55)) for _ in range(40)]
    text = lambda w: " ".join(w[:-6]) + ". " + " ".join(w[-6:])
    bench = [(i, text(w)) for i, w in enumerate(items)] + [(100, None), (101, ""), (102, "tiny item"), (0, text(items[0]))]
    rows, want = [], set()

    def add(body, leak=None):
        rows.append((len(rows), " ".join(item(random.randint(0, 200)) + body + item(random.randint(0, 200)))))
        if leak is not None:
            want.add((len(rows) - 1, leak))

    for i, w in enumerate(items):
        add(w, i)
        add([x if random.random() > 0.12 else "zz" for x in w], i)  # edited
        add([*(x for k, x in enumerate(w[:-6]) if k % 5 < 3 or len(w) < 20), *w[-6:]], i)  # shortened, with the answer
        add(w[: len(w) // 3])
        add([])
    add(["tiny", "item"], 102)
    add(["tiny", "big", "item"])
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS cosine")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for size in (512, 16):  # one block, and several
        found = decontaminate.find_leaks(docs, benchmark, size)
        got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
        assert not got - want and len(want & got) >= 0.95 * len(want)
        assert all(p in got for p in want if p[0] % 5 == 0)
    kept = decontaminate.drop_leaking(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([i for i, _ in rows if i not in {d for d, _ in got}] + [-1, 9999])
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_full_blocks_keep_whole_items(spark):
    """Each of 300 unlike items in one block has cosine 1 with its own text."""
    texts = [" ".join(f"u{i}x{k}" for k in range(15)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find_leaks(docs, docs.withColumnRenamed("doc_id", "item_id"), 512).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(300)}
    assert min(r["cosine"] for r in found) > 0.999


def test_long_items_are_found(spark):
    """An item of 2,000 words copied whole, and half of another's words with its answer."""
    items = [[f"l{i}x{k}" for k in range(n)] for i, n in enumerate((2000, 600))]
    text = lambda w: " ".join(w[:-6]) + ". " + " ".join(w[-6:])
    noise = lambda k: [f"n{k}x{j}" for j in range(100)]
    half = [x if k % 2 or k >= 594 else f"o{k}" for k, x in enumerate(items[1])]
    rows = [(0, noise(0) + items[0] + noise(1)), (1, noise(2) + half + noise(3)), (2, noise(4) + items[0][:900])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, text(w)) for i, w in enumerate(items)], "item_id long, text string")
    for size in (512, 16):
        found = decontaminate.find_leaks(docs, bench, size).collect()
        assert {(r["doc_id"], r["item_id"], r["answer"]) for r in found} == {(0, 0, True), (1, 1, True)}
        assert {r["doc_id"]: r["covered"] for r in found}[0] == 1


def test_common_words_among_rare_ones_are_found(spark):
    """Verbatim items of common words, among words that no other document has, in a corpus of 40,000."""
    common = [f"c{k}" for k in range(12)]
    rare = lambda i, n: [f"r{i}x{k}" for k in range(n)]
    filler = spark.range(40_000).selectExpr("id AS doc_id", "IF(id %% 4 = 0, concat_ws(' ', reverse(array(%s))), 'f') AS text" % ", ".join(f"'{w}'" for w in common))
    leaks = [(10**6, rare(0, 40) + common + rare(1, 40)), (10**6 + 1, rare(2, 41) + common[:3] + rare(3, 40))]
    docs = filler.union(spark.createDataFrame([(i, " ".join(w)) for i, w in leaks], "doc_id long, text string"))
    bench = spark.createDataFrame([(0, " ".join(common)), (1, " ".join(common[:3]))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).where("doc_id >= 1000000").collect()}
    assert found == {(10**6, 0), (10**6, 1), (10**6 + 1, 1)}


def paraphrases(seed=6):
    """Documents of topics whose words are used alike, items, and copies with all rare words replaced."""
    rng = random.Random(seed)
    topics = [[f"t{k}w{j}" for j in range(150)] for k in range(20)]
    common = [f"c{k}" for k in range(40)]

    def mixed(of, n):
        return [w for _ in range(n) for w in (rng.choice(common), rng.choice(topics[rng.choice(of)]))]

    rows = [" ".join(mixed(rng.sample(range(20), 2), 60)) for _ in range(2500)]
    items, leaks = [], []
    for k in range(60):
        of = rng.sample(range(20), 2)
        body, answer = mixed(of, 12), rng.sample(common, 4)
        topic = {w: t for t in topics for w in t}
        other = [rng.choice([x for x in topic[w] if x != w]) if w in topic else w for w in body]
        items.append((k, " ".join(body) + ". " + " ".join(answer)))
        leaks.append((10_000 + k, " ".join(mixed(of, 20)) + " " + " ".join(other + answer) + " " + " ".join(mixed(of, 20))))
    return list(enumerate(rows)) + leaks, items


def test_paraphrases_in_other_words_are_found(spark):
    """Half of an item's words, the common ones, and its answer; every rare word is another of its topic."""
    rows, items = paraphrases()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10_000 + k, k) for k, _ in items}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_latent_space_of_all_passages(spark):
    """The directions hold as much of all passages, middles of documents and all items too, as the best can."""
    rng = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(40)]
    text = lambda k, n: " ".join(rng.choice(topics[k]) for _ in range(n))
    # Each document has a topic of its own place: ends from the first ten, the middle from all.
    docs = [" ".join([text(i % 10, 96), text(rng.randrange(10, 40), 160), text(i % 7, 96)]) for i in range(150)]
    items = [text(rng.randrange(40), n) for n in (5, 17, 18, 60)]
    made = lambda rows: spark.createDataFrame([(t,) for t in [*rows, None, ""]], "text string").repartition(3)
    corpus = decontaminate.fit(made(docs), made(items))
    passages = [w[k:k + 32] for w in map(decontaminate.words_of, docs) for k in range(0, len(w), 32)]
    passages += [p for t in items for p in decontaminate.pieces_of(decontaminate.words_of(t))]
    df = Counter(b for t in docs for b in set(decontaminate.buckets_of(decontaminate.words_of(t)).tolist()))
    rows = np.zeros((len(passages), decontaminate.LATENT_WORDS), np.float32)
    for row, words in zip(rows, passages):
        count = Counter(decontaminate.buckets_of(words).tolist())
        x = np.array([n * (np.log((len(docs) + 4) / (df[b] + 1)) + 0.01) for b, n in count.items()])
        np.add.at(row, np.array(list(count)) & (decontaminate.LATENT_WORDS - 1), x / np.linalg.norm(x))
    used = rows.any(0)
    best = np.linalg.svd(rows[:, used], compute_uv=False)[:decontaminate.RANK]
    assert np.allclose(corpus.factors.T @ corpus.factors, np.eye(decontaminate.RANK), atol=1e-5)
    assert ((rows @ corpus.factors) ** 2).sum() >= 0.99 * (best ** 2).sum()


def test_sums_over_passages_in_three_products(spark, monkeypatch):
    """Products and random sums against dense ones; the latent space asks for three products of all passages."""
    rng = np.random.default_rng(3)
    docs = [" ".join(f"w{int(j)}" for j in rng.zipf(1.3, 200) % 500) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in docs], "text string").repartition(4)
    passages = decontaminate.hashed_passages(rows, rows.limit(0))
    idf = rng.random(decontaminate.BUCKETS).astype(np.float32) + 1
    dense = np.zeros((60 * 7, decontaminate.LATENT_WORDS))
    for k, words in enumerate(w[c:c + 32] for w in map(decontaminate.words_of, docs) for c in range(0, 200, 32)):
        count = Counter(decontaminate.buckets_of(words).tolist())
        x = np.array([n * idf[b] for b, n in count.items()])
        np.add.at(dense[k], np.array(list(count)) & (decontaminate.LATENT_WORDS - 1), x / np.linalg.norm(x))
    m = rng.normal(size=(decontaminate.LATENT_WORDS, 5)).astype(np.float32)
    assert np.allclose(decontaminate.product(passages, idf, m), dense.T @ (dense @ m), atol=1e-3)
    sums = decontaminate.sketch(passages, idf, decontaminate.LATENT_WORDS, 8)
    used = np.flatnonzero(dense.any(0))
    seen = np.linalg.lstsq(dense.T[used], sums[used], rcond=None)[0]  # every passage in one of the sums
    assert np.allclose(dense.T @ seen, sums, atol=1e-4) and np.linalg.matrix_rank(sums) == 8
    calls, whole = [], decontaminate.product
    monkeypatch.setattr(decontaminate, "product", lambda *x: calls.append(x) or whole(*x))
    found = decontaminate.randomised_svd(passages, idf, decontaminate.LATENT_WORDS, 24)
    best = np.linalg.svd(dense[:, used], compute_uv=False)[:24]
    assert len(calls) <= 3 and ((dense @ found) ** 2).sum() >= 0.98 * (best ** 2).sum()


def test_exact_search_against_all_pairs(monkeypatch):
    """Every passage of a document against every passage of an item, by plain sums."""
    rng = random.Random(12)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 17, 33, 70, 200]))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 12, 17, 18, 40])))) for i in range(30)]
    idf = np.linspace(0.2, 6, decontaminate.BUCKETS).astype(np.float32)
    rng.shuffle(words)
    corpus = decontaminate.Corpus(idf, np.zeros((decontaminate.LATENT_WORDS, 4), np.float32))
    searcher = decontaminate.Searcher(decontaminate.prepare(corpus, [(i, decontaminate.words_of(t), t) for i, t in items]))
    seen = []
    monkeypatch.setattr(searcher, "_verify", lambda words, i, places, found: seen.append((b" ".join(words), i, places)))
    searcher.search(texts)
    weight = lambda w: float(idf[decontaminate.buckets_of([w])[0]])
    want = []
    for text in texts:
        split = decontaminate.words_of(text)
        for i, (_, item) in enumerate(items):
            places = {}
            for start in range(0, max(1, len(split) - 16) if split else 0, 16):
                window = Counter(split[start:start + 32])
                heavy = math.sqrt(sum((n * weight(w)) ** 2 for w, n in window.items()))
                for piece in decontaminate.pieces_of(decontaminate.words_of(item)):
                    own = Counter(piece)
                    norm = math.sqrt(sum((n * weight(w)) ** 2 for w, n in own.items()))
                    product = sum(min(n, window[w]) * n * weight(w) ** 2 for w, n in own.items()) / norm
                    if product >= decontaminate.CANDIDATE * min(heavy, norm):
                        places[start] = max(places.get(start, 0), product / heavy)
            if places:
                want.append((b" ".join(split), i, places))
    key = lambda x: (x[0], x[1])
    assert [key(x) for x in sorted(seen, key=key)] == [key(x) for x in sorted(want, key=key)] and len(want) > 100
    for a, b in zip(sorted(seen, key=key), sorted(want, key=key)):
        assert a[2].keys() == b[2].keys() and all(abs(a[2][k] - b[2][k]) < 1e-5 for k in b[2])


def test_items_that_share_an_id_are_all_searched(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, one), (7, two), (7, one)], "item_id long, text string")
    for size in (512, 2):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, size).collect())
        assert got == [(1, 7), (2, 7)]
    assert [r["doc_id"] for r in decontaminate.drop_leaking(docs, bench).collect()] == [3]


def test_op5_finds_every_passage(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op5_decontamination"](spark, DATA).collect()} == want


def test_words_of_items_and_passages_by_narrow_numbers():
    """Numbers of words whose hashes share a bucket, and distinct buckets of each passage, against plain ones."""
    words = [f"w{k}".encode() for k in range(6000)]
    items = [(i, words[c:c + 17], "") for i, c in enumerate(range(0, 3000, 17))]
    corpus = decontaminate.Corpus(np.ones(decontaminate.BUCKETS, np.float32), np.zeros((decontaminate.LATENT_WORDS, 4), np.float32))
    prepared = decontaminate.prepare(corpus, items)
    searcher, hashes = decontaminate.Searcher(prepared), decontaminate.hashes_of(words)
    assert searcher.several.any()
    assert searcher._terms(hashes, decontaminate.buckets(hashes)).tolist() == [prepared.vocabulary.get(w, -1) for w in words]
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 300)
    bucket = rng.integers(0, 40, lengths.sum()).astype(np.int32)
    ends, found = np.cumsum(lengths), decontaminate.counted(bucket, lengths)
    want = [np.unique(bucket[e - n:e], return_counts=True) for e, n in zip(ends, lengths)]
    for k in (0, 1):
        assert np.array_equal(found[k], np.concatenate([x[k] for x in want]))
    assert found[2].tolist() == [len(x[0]) for x in want]


def test_texts_without_enough_of_an_items_words_are_not_split(monkeypatch):
    item = " ".join(f"w{k}" for k in range(17))
    corpus = decontaminate.Corpus(np.ones(decontaminate.BUCKETS, np.float32), np.zeros((decontaminate.LATENT_WORDS, 4), np.float32))
    searcher = decontaminate.Searcher(decontaminate.prepare(corpus, [(7, decontaminate.words_of(item), item)]))
    split, of = [], decontaminate.Words.of
    monkeypatch.setattr(decontaminate.Words, "of", lambda self, text: split.append(text) or of(self, text))
    found = searcher.search(["w1 w2 w3 w4 w5 x y z", f"x {item} y", "", "x y z"])
    assert [sorted(x) for x in found] == [[], [0], [], []] and split == [1]
