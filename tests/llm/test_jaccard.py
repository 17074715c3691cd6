import random

import pytest

from tagloom.llm import catalog, jaccard
from tagloom.llm.components import components

from .plain import DATA, HARD, groups, hard


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus():
    """Chains of edits, groups of copies, a passage that many texts share, short texts."""
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    passage = random.choices(words, k=60)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(12):
        base = random.choices(words, k=random.randint(20, 200))
        for _ in range(random.randint(1, 9)):
            add(" ".join(base))
            base = list(base)
            for _ in range(random.randint(0, 5)):
                base[random.randrange(len(base))] = random.choice(words)
    for _ in range(60):
        add(" ".join(random.choices(words, k=random.randint(5, 80)) + passage))
    for k in range(40):
        add(" ".join(passage[:k]))
    origin = random.choices(words, k=120)
    for _ in range(80):
        copy = list(origin)
        copy[random.randrange(120)] = random.choice(words)
        add(" ".join(copy))
    for text in ("", None, "A b", "a B", "a b c", "  ", "the the the the the", "the the the the"):
        add(text)
    return rows


@pytest.mark.parametrize("hot", [256, 4])
def test_components_against_all_pairs(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(jaccard.similar(docs, 4, 85, hot)) == groups(rows)


def test_op9_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found(catalog.QUERIES["op9_ngram_jaccard_join"](spark, DATA)) == groups(rows)


def test_hard_rows(spark):
    docs = hard(spark)
    rows = jaccard.similar(docs).collect()
    assert len(rows) == len(HARD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[1] == (0, 1) and by[3] == (0, 3) and by[5] == (1, 5) and by[6] == (1, 6)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in HARD)
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components(edges).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_sets_are_found_under_every_order(spark):
    """Similar sets share a token in the prefixes of each order, whatever the frequencies."""
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(200):
        base = np.unique(rng.integers(1, 10**6, 60))
        n = len(base)
        other = np.unique(np.append(base[: n - 4], rng.integers(1, 10**6, 3)))
        both = np.intersect1d(base, other)
        if 100 * len(both) < 85 * len(np.union1d(base, other)):
            continue
        df = {int(t): int(x) for t, x in zip(np.union1d(base, other), rng.integers(2, 50, 200))}
        sides = [jaccard.prefixes(len(s), s, np.array([df[int(t)] for t in s]), 85) for s in (base, other)]
        assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(*sides))
