import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import catalog, merkle
from tagloom.plans import ordered

from .plain import DATA, hard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    values = (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of digests, and the siblings (left, right) of each on every level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p - p % 8
            steps[k].append((nodes[first:p], nodes[p + 1:first + 8]))
        at = [p // 8 for p in at]
        nodes = [sha(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], steps


def plain(docs, tamper):
    trees, out = {}, []
    for d in docs:
        trees.setdefault(d["lang"], []).append(d)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for name in names:
        own = sorted(trees[name], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        below[name] = own, *climb([leaf(d, d["text"]) for d in own])
    root, above = climb([below[name][1] for name in names])
    for name, more in zip(names, above):
        own, subroot, steps = below[name]
        for d, mine in zip(own, steps):
            path = mine + more
            node = leaf(d, tamper(d))
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((d["doc_id"], leaf(d, d["text"]), subroot, root, sha(*(x for a, b in path for x in (*a, *b))), node, node == root))
    return out


def lowered(d):
    if d["doc_id"] is None or d["text"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 3:
        return d["text"]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"])


def both(docs):
    tampered = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)),
                      F.translate("text", merkle.CAPITALS, merkle.SMALL)).otherwise(F.col("text"))
    order = lambda rows: sorted(rows, key=str)
    got = [tuple(r) for r in merkle.verify(merkle.manifest(docs, tampered)).collect()]
    return order(got), order(plain([r.asDict() for r in docs.select(*SCHEMA.replace(",", "").split()[::2]).collect()], lowered))


@pytest.mark.parametrize("sizes", [(1,), (1, 2), (8, 9, 1), (64, 65, 512, 513, 3), (700, 1, 8)])
def test_trees_of_all_heights(spark, monkeypatch, sizes):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 200)
    rng = random.Random(len(sizes))
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, rng.choice(["Text", "text", "É A", "", None]), [None, "en", "de", "é", "zz"][k], "s", rng.choice([None, 4])))
            n += 1
    rng.shuffle(rows)
    got, want = both(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == want


def test_several_stored_levels(spark, monkeypatch):
    """Trees of more than two stored levels, with runs of two nodes instead of eight."""
    rows = [(i, f"T{i}", "en" if i % 5 else "de", "s", i) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(merkle, "STEP", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    got, want = both(docs)
    assert got == want
    assert len(merkle.build(docs.selectExpr("lang AS key", "doc_id AS at", "text AS digest")).levels) >= 2


def test_repeated_and_hard_rows(spark):
    docs = hard(spark).drop("lang", "source").selectExpr(
        "*", "CASE WHEN doc_id < 5 THEN 'en' END AS lang", "'s' AS source", "CAST(NULL AS BIGINT) AS n_chars")
    for name in ("key", "at", "digest", "height", "up", "part", "steps", "root"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    got, want = both(docs)
    assert got == want and len(got) == docs.count()
    assert merkle.verify(merkle.manifest(docs.limit(0))).count() == 0


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = catalog.QUERIES["op13_merkle_manifest"](spark, DATA).collect()
    want = plain(rows, lowered)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {True, False} == {r["verified"] for r in got}
