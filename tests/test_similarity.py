import numpy as np
import pytest

from tagloom.operators import similarity


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors, a third of them copies of one, and a zero vector."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + 0.3 * rng.standard_normal(8)).astype(np.float32)])
            for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(200, [0.0] * 8)]
    return spark.createDataFrame(rows, "tid bigint, vec array<float>").repartition(4)


def brute(vectors):
    rows = sorted((r["tid"], r["vec"]) for r in vectors.collect())
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows])
    norms = np.linalg.norm(matrix, axis=1)
    norms[norms == 0] = 1e-8
    return ids, (matrix / norms[:, None]) @ (matrix / norms[:, None]).T


@pytest.mark.parametrize("threshold, block_rows", [(0.8, 8192), (0.8, 10), (0.0, 10), (-1.0, 16), (0.95, 5)])
def test_pairs(vectors, threshold, block_rows):
    ids, sims = brute(vectors)
    single = [i for i, t in enumerate(ids) if t < 100 or t == 200]
    want = {(ids[a], ids[b]): sims[a, b] for a in single for b in single if a != b and sims[a, b] >= threshold}
    got = {(r["src"], r["dst"]): r["w"] for r in similarity.cosine_pairs(vectors, threshold, block_rows).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("threshold, k, block_rows", [(0.8, 6, 8192), (0.8, 6, 10), (0.5, 2, 7), (0.99, 4, 9)])
def test_graph_with_copies(vectors, threshold, k, block_rows):
    ids, sims = brute(vectors)
    want = set()
    for a, src in enumerate(ids):
        best = sorted((-round(sims[a, b], 9), dst) for b, dst in enumerate(ids)
                      if a != b and round(sims[a, b], 9) >= threshold)[:k]
        want |= {(src, dst, rank + 1) for rank, (_, dst) in enumerate(best)}
    got = {(r["src"], r["dst"], r["rank"])
           for r in similarity.similarity_graph(vectors, threshold, k, block_rows).collect()}
    assert got == want


def test_far_blocks_do_not_meet(vectors):
    """Clusters of unlike vectors are not sent to each other."""
    single = similarity.distinct_vectors(vectors)
    met = similarity._block_pairs(single, 0.95, 10).count()
    assert met < similarity._block_pairs(single, -1.0, 10).count()


def test_neighbours_break_ties_by_id(spark):
    pairs = spark.createDataFrame(
        [(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.95), (1, 1, 1.0), (2, 1, 0.7)], "src int, dst int, w double")
    got = sorted((r["src"], r["dst"], r["rank"]) for r in similarity.topk_neighbours(pairs, 2).collect())
    assert got == [(1, 2, 2), (1, 4, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "tid bigint, vec array<float>")
    assert similarity.cosine_pairs(none).count() == 0
    assert similarity.similarity_graph(none).count() == 0


def test_models_and_lengths_do_not_meet(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [1.0, 0.0]), (4, "b", [0.9, 0.1]), (5, "a", [1.0, 0.0, 0.0]),
            (6, None, [1.0, 0.0]), (7, None, [0.9, 0.1]), (8, "a", None)]
    df = spark.createDataFrame(rows, "tid bigint, mdl string, vec array<float>")
    got = similarity.per_model(df, similarity.cosine_pairs, threshold=0.8).collect()
    assert sorted((r["mdl"] or "", r["src"], r["dst"]) for r in got) == [
        ("", 6, 7), ("", 7, 6), ("a", 1, 2), ("a", 2, 1), ("b", 3, 4), ("b", 4, 3)]
    assert similarity.per_model(df.limit(0), similarity.similarity_graph, threshold=0.8).count() == 0


def test_neighbours_of_copies(spark):
    """Ids 1 and 2 have one vector, 3 is near: each is in the others' lists."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [-1.0, 0.5]), (5, None)]
    df = spark.createDataFrame(rows, "tid bigint, vec array<float>")
    got = similarity.topk_neighbours(similarity.cosine_pairs(df), vectors=df).collect()
    assert sorted((r["src"], r["dst"], r["rank"]) for r in got) == [
        (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]
    assert {(r["tid"], r["rep"]) for r in similarity.copies_of(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


@pytest.mark.parametrize("threshold, k", [(0.8, 6), (0.5, 2), (0.99, 40)])
def test_neighbours_with_copies(vectors, threshold, k):
    ids, sims = brute(vectors)
    want = set()
    for a, src in enumerate(ids):
        best = sorted((-round(sims[a, b], 9), dst) for b, dst in enumerate(ids)
                      if a != b and round(sims[a, b], 9) >= threshold)[:k]
        want |= {(src, dst, rank + 1) for rank, (_, dst) in enumerate(best)}
    pairs = similarity.cosine_pairs(vectors, threshold - 0.1)
    got = {(r["src"], r["dst"], r["rank"]) for r in similarity.topk_neighbours(pairs, k, threshold, vectors).collect()}
    assert got == want


@pytest.mark.parametrize("threshold, plan", [
    (0.3, similarity.bucket_plan(0.3, 10**8)), (0.8, similarity.bucket_plan(0.8, 10**5)), (0.8, similarity.BucketPlan(6, 1, 5)),
    (0.3, None)])
def test_recall_of_the_approximate_form(spark, threshold, plan):
    """Unclustered vectors, most of whose pairs lie just over the threshold; also with small blocks."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 64))
    spread = 0.7 if threshold > 0.5 else 1.4
    rows = [(i, [float(x) for x in (base[i % 250] + spread * (i >= 250) * rng.standard_normal(64)).astype(np.float32)]) for i in range(750)]
    df = spark.createDataFrame(rows, "tid bigint, vec array<float>").repartition(4)
    ids, sims = brute(df)
    want = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(sims >= threshold)) if a != b}
    got = {(r["src"], r["dst"]): r["w"] for r in similarity.cosine_pairs_approx(df, threshold, block_rows=50, plan=plan).collect()}
    assert len(want) > 400 and set(got) <= want
    assert len(got) >= (0.9 if plan else 1.0) * len(want)
    assert all(w == pytest.approx(sims[a, b], abs=1e-9) for (a, b), w in got.items())


def test_pairs_of_all_vectors_are_not_shuffled(spark, vectors):
    """Without bits each pair is found once, where two stored blocks are read; in one table too."""
    ids, sims = brute(similarity.distinct_vectors(vectors).select("tid", "vec"))
    want = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(sims >= 0.3)) if a != b}
    found = similarity.cosine_pairs_approx(vectors, 0.3, block_rows=7)
    rows = [(r["src"], r["dst"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan
    once = similarity.cosine_pairs_approx(vectors, 0.3, block_rows=7, plan=similarity.BucketPlan(2, 1, 1))
    rows = [(r["src"], r["dst"]) for r in once.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert "HashAggregate" not in once._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_their_recall():
    for threshold in (0.0, 0.3, 0.5, 0.8, 0.95):
        for count in (10, 10**4, 10**6, 10**9):
            plan = similarity.bucket_plan(threshold, count)
            assert plan.recall(threshold) >= similarity.RECALL and plan.recall(0.99) >= plan.recall(threshold)
    assert similarity.bucket_plan(0.8, 10).bits == 0 and similarity.bucket_plan(0.8, 10**7).bits > 8
    assert similarity.bucket_plan(-0.5, 10**7).bits == 0
