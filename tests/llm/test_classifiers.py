import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import catalog, common, embeddings, quality, toxicity

from .plain import HARD, hard

BIG = "/root/testdata/sf0.1"


def held_out(spark, name, label, count, fold):
    scored = catalog.QUERIES[name](spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
    assert len(rows) > 300 and all(zlib.crc32(str(r["doc_id"]).encode()) % count == fold for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_rows(spark):
    got, want = held_out(spark, "op1_quality_classifier", "quality", 4, 2)
    assert (got == want).mean() > 0.97 and got[want == 1].mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    got, want = held_out(spark, "op4_toxicity", "toxic", 5, 0)
    assert (got == want).mean() > 0.94 and got[want == 0].mean() < 0.04


def test_unseen_spellings_share_n_grams():
    random.seed(1)
    plain = ["the", "a", "of", "river", "stone", "walks", "green", "under", "seven", "paper", "lamp", "slow"]
    make = lambda bad: " ".join(random.choices(plain, k=20) + ([bad] if bad else []))
    texts = [make("horridness" if k % 3 == 0 else "") for k in range(300)]
    model = embeddings.train(texts, [int(k % 3 == 0) for k in range(300)], toxicity.FEATURES, toxicity.TRAINING)
    scores = embeddings.Scorer(model).score([make("horridnesss"), make("xhorridness"), make("")])
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.5


def test_scores_do_not_depend_on_neighbours_or_tables():
    model = embeddings.train(["good text here", "BAD!! BAD!!"] * 20, [1, 0] * 20, quality.FEATURES)
    scorer = embeddings.Scorer(model)
    texts = [f"some words {k} here" for k in range(50)] + ["", "x", "same same same"]
    together = scorer.score(texts)
    scorer.words.most = 5
    assert np.allclose(together, [scorer.score([t])[0] for t in texts])


@pytest.mark.parametrize("features", [quality.FEATURES, toxicity.FEATURES])
def test_scores_against_plain_means_and_softmax(features):
    """The sum of numbers per bucket against the mean of the features, one by one."""
    random.seed(3)
    texts = [" ".join(random.choices(["good", "Good", "bad!", "BAD", "é", "plain", "text", "x"], k=random.randint(0, 40))) for _ in range(60)]
    model = embeddings.train(texts, [int("bad!" in t) for t in texts], features, embeddings.Training(most=60, batch=8, telling=1.0))
    got = embeddings.Scorer(model).score(texts)
    for text, score in zip(texts, got):
        words, total, count = features.words(text), 0.0, 0.0
        hashes = []
        for word in words:
            own, _, buckets, weights = features.of_words([word])
            hashes.append(own[0])
            for bucket, weight in zip(buckets, weights):
                total += float(model.weights[bucket]) * weight
                count += float(model.mass[bucket]) * weight
        if features.pairs:
            for a, b in zip(hashes, hashes[1:]):
                bucket = int(features.of_pairs(np.array([a, b], np.uint64))[0])
                total, count = total + float(model.weights[bucket]), count + float(model.mass[bucket])
        z = np.array([0, total / max(count, 1e-9) + model.bias])
        assert score == pytest.approx((np.exp(z) / np.exp(z).sum())[1], abs=1e-5)


def test_model_is_the_one_of_the_sample(spark):
    """Trained in a task, on the chosen rows in order of ids."""
    rows = [(i, f"text {i % 7} of {'good' if i % 2 else 'BAD!!'} words") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    how = embeddings.Training(most=500, batch=16)
    model = embeddings.fit(docs, labels, "quality", quality.FEATURES, how)
    want = embeddings.train([t for _, t in rows], [i % 2 for i, _ in rows], quality.FEATURES, how)
    assert np.array_equal(model.weights, want.weights) and model.bias == pytest.approx(want.bias)


def test_every_labelled_row_is_learnt_from(spark):
    """Each of 600 documents has a telling word of its own, and rows of 50 documents hold them."""
    rows = [(i, f"plain text w{i}x{i * 7919 % 1009} stands here") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int").alias("quality"))
    features, how = embeddings.Features(bits=20, shortest=40, longest=3), embeddings.Training(most=50, rounds=40)
    model = embeddings.fit(docs, labels, "quality", features, how)
    truth = np.array([zlib.crc32(str(i).encode()) % 2 for i, _ in rows])
    assert ((embeddings.Scorer(model).score([t for _, t in rows]) > 0.5) == truth).all()
    own = np.array([features.of_words([t.split()[2]])[2][0] for _, t in rows])
    assert len(set(own)) > 590 and (model.weights[own] != 0).all()


def test_steps_against_plain_gradients():
    """One round's weights from dense shares and errors, with and without features that tell nothing."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["good", "bad!", "é", "plain", "text", "longerword", "x"], k=rng.randint(0, 30))) for _ in range(40)]
    y = np.array([int("bad!" in t and rng.random() < 0.9) for t in texts])
    for features, telling in ((embeddings.Features(bits=10), 0.0), (embeddings.Features(bits=10, pairs=False, fold=True), 1.0)):
        how = embeddings.Training(most=9, rounds=1, batch=4, telling=telling)
        shares = np.zeros((len(texts), 1 << features.bits))
        for row, text in zip(shares, texts):
            words = features.words(text)
            for w in words:
                _, _, buckets, weights = features.of_words([w])
                np.add.at(row, buckets, weights)
            if features.pairs and len(words) > 1:
                np.add.at(row, features.of_pairs(features.of_words(words)[0]), 1)
        tells, had = np.ones(shares.shape[1], bool), shares > 0
        if telling:
            p = (had.sum(0) + 1) / (len(y) + 2)
            gap = np.abs(had[y == 1].mean(0) - had[y == 0].mean(0))
            tells = gap >= telling * np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum())))
            assert 0 < tells[had.any(0)].sum() < had.any(0).sum()
        shares *= np.where(tells, 1, how.rest)
        shares /= np.maximum(shares.sum(1, keepdims=True), 1e-9)
        slope = (shares * (0.5 - y)[:, None]).mean(0) * tells
        model = embeddings.train(texts, y.tolist(), features, how)
        head = np.random.default_rng(how.seed).normal(0, how.width ** -0.5, (how.width, 2))
        across = head[:, 1] - head[:, 0]
        want = -how.rate * np.sign(slope) / np.sqrt((across ** 2).mean()) * (across @ across)
        some = np.abs(slope) > 1e-6
        assert some.sum() > 20 and np.allclose(model.weights[some], want[some], rtol=1e-3)
        assert model.bias == pytest.approx(-2 * how.rate * (0.5 - y).mean())


def test_hard_rows_and_missing_labels(spark):
    docs = hard(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (5, 1, 0), (77, 0, 1), (None, 1, 1), (6, None, None)],
                                 "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for method in (quality.classify, toxicity.classify):
            rows = method(docs, labels).collect()
            assert len(rows) == len(HARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), some).count() == 0
    kept = quality.keep_good(docs, some, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(HARD)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of words") for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(quality.fold_of(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.classify(docs, labels).collect()) == sorted(quality.classify(docs, turned).collect())


def test_rows_of_the_table_of_words_are_small(spark):
    """The table holds words, not their n-grams, and a chunk makes those of each word as ``of_words`` does."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeé𝄞<>", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 60))) for _ in range(90)]
    for features in (quality.FEATURES, toxicity.FEATURES):
        for row in embeddings.rows_of(features, texts, [k % 2 for k in range(90)], 40):
            chunk = embeddings.Chunk(*row, features)
            assert sum(x.nbytes for x in row) < chunk.grams.nbytes / 2
            marked, at, words = chunk.text.tobytes().decode(), 0, []
            for n in chunk.lengths:
                words.append(marked[at + 1:at + n - 1])
                at += n
            _, of, buckets, weights = features.of_words(words)
            ends = np.cumsum(chunk.many)
            for k in range(len(words)):
                assert sorted(buckets[of == k]) == sorted(chunk.grams[ends[k] - chunk.many[k]:ends[k]])
            assert np.allclose(weights[of == 0].sum(), 1 + (chunk.many[0] - 1) * chunk.weight[0], atol=1e-3)


def test_sums_come_from_few_tasks(spark, monkeypatch):
    """A table of many files is added up by a task per core or less: each task sends a number per bucket on."""
    features = quality.FEATURES
    columns, kinds = embeddings.COLUMNS, ", ".join(f"{c} binary" for c in embeddings.COLUMNS)
    row = next(embeddings.rows_of(features, ["good text", "bad text"], [1, 0], 9))
    table = spark.createDataFrame([[bytearray(x.tobytes()) for x in row]] * 60, kinds).repartition(60)
    assert columns == table.columns and table.rdd.getNumPartitions() == 60
    coalesced, own = [], type(table).coalesce
    monkeypatch.setattr(type(table), "coalesce", lambda self, n: coalesced.append(n) or own(self, n))
    summed = embeddings.summed_over(table, features)
    assert summed(lambda chunk: chunk.label.astype(float), 2).tolist() == [60, 0]
    assert coalesced == [max(spark.sparkContext.defaultParallelism, 4)]


def test_only_labelled_rows_reach_the_join(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in [*range(3000), 5, None]], "doc_id long, text string")
    known = spark.createDataFrame([(i,) for i in range(0, 3000, 30)], "doc_id int")
    kept = [r["doc_id"] for r in embeddings.perhaps_in(docs, known).collect()]
    assert set(range(0, 3000, 30)) <= set(kept) and len(kept) < 130
    doubled = spark.createDataFrame([(30, "a"), (30, "b"), (31, "c")], "doc_id long, text string")
    assert sorted(r["text"] for r in embeddings.perhaps_in(doubled, known).collect()) == ["a", "b"]


def test_training_tasks_let_go_of_another_operators_tables(spark):
    """A worker that has scored texts holds the scorer; a task of a round holds nothing besides its sums."""
    rows = spark.createDataFrame([(k, f"some word{k}") for k in range(40)], "doc_id long, text string").repartition(4)
    size = 1 << quality.FEATURES.bits
    model = embeddings.Model(quality.FEATURES, np.zeros(size, np.float32), np.ones(size, np.float32), 0.0)
    assert embeddings.score(rows, model).count() == 40 and len(embeddings.score(rows, model).collect()) == 40
    own = list(embeddings.rows_of(quality.FEATURES, [f"some word{k}" for k in range(40)], [k % 2 for k in range(40)], 5))
    chunks = spark.createDataFrame([tuple(x.tobytes() for x in row) for row in own], ", ".join(f"{c} binary" for c in embeddings.COLUMNS))
    summed = embeddings.summed_over(chunks.repartition(8), quality.FEATURES)
    assert summed(lambda chunk: np.array([float(len(common._HELD))]), 1).tolist() == [0]
