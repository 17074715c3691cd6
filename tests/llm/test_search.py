import math

import numpy as np
import pytest

from tagloom.llm import catalog, topk, urls

from .plain import DATA


def plain_best(rows, every, k):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * y) for y in v]))
    out = []
    for own, (q, x) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for n, (i, y) in enumerate(whole) if n != own and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def told(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_topk_against_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # ties
    rows += [(2000, None), (2050, [1.0, None, *[0.0] * 6]), (2100, [math.nan] * 8), (2150, [math.inf] * 8), (None, [1.0] * 8)]
    rows += [(3000, [0.0] * 8), (50, [9.0] * 8), (3, rows[3][1]), (4000, [1.0, 2.0]), (4001, [3.0, -1.0])]
    rows += [(3, rows[3][1]), (100, rows[100][1]), (100, [2.0] * 8), (5000, []), (5001, []), (5000, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    monkeypatch.setattr(topk, "ROWS", 200)
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert told(topk.top_k(df, 50, 5)) == plain_best(rows, 50, 5)
    assert topk.top_k(df.limit(0), 50, 5).count() == 0


def test_scores_of_any_size(spark):
    """Products beyond 64 bits rank rightly, and end the job only where one is among the best."""
    big = 2.0 ** 40
    rows = [(50, [big, 1.0])] + [(i, [-big * i, float(i)]) for i in range(1, 8)] + [(20 + i, [i / 256, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert told(topk.top_k(df, 50, 5)) == plain_best(rows, 50, 5)
    for bad in ([(50, [big, 1.0]), (1, [big, 1.0])], [(50, [1e30, 1.0]), (1, [1.0, 1.0])]):
        with pytest.raises(Exception, match="64|too large|long"):
            topk.top_k(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), 50, 5).collect()


def test_topk_broadcasts_nothing(spark, monkeypatch):
    """What meets is read where it is compared: no exchange and no broadcast holds blocks once per pair."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(900)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 5)
    best = topk.top_k(df, 10, 5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert told(best) == plain_best(rows, 10, 5)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    monkeypatch.setattr(topk, "COMPONENTS", 300)
    assert told(topk.top_k(df, 10, 5)) == plain_best(rows, 10, 5)


@pytest.mark.parametrize("size", [300, 10**6, 10**9, 10**14])
def test_queries_meet_blocks_together(size):
    """In floats of 32 and 64 bits that hold all sums, and in whole numbers of 64 bits and of more."""
    rng = np.random.default_rng(size)
    vectors = rng.integers(-size, size, (900, 10))
    vectors[100:180], vectors[500:520] = vectors[7], 0
    ids = rng.permutation(900)
    rows, queries = np.arange(900), np.flatnonzero(np.arange(900) % 6 == 1)
    asked = topk.Asked(rows[queries], ids[queries], vectors[queries], 5)
    for at in range(0, 900, 300):
        asked.meet(topk.SortedLists(rows[at:at + 300], ids[at:at + 300], vectors[at:at + 300]))
    got = list(zip(asked.asked.tolist(), asked.found.tolist(), asked.scores.tolist()))
    exact = vectors.astype(object) @ vectors[queries].astype(object).T
    want = [(n, *b) for n, q in enumerate(queries) for b in (
        (int(ids[j]), int(exact[j, n])) for j in sorted((j for j in rows if j != q), key=lambda j: (-exact[j, n], ids[j]))[:5])]
    assert got == want


def test_lists_stop_early_and_lose_nothing():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (2000, 6))
    vectors[:20] *= 4
    ids = np.arange(2000)
    block = topk.SortedLists(ids, ids, vectors)
    for q in range(0, 200, 20):
        scores = vectors @ vectors[q]
        scores[q] = -(10**9)
        want = np.lexsort((ids, -scores))[:5]
        got, best = block.best(q, vectors[q], 5)
        assert got.tolist() == want.tolist() and best.tolist() == scores[want].tolist()
        again, _ = block.best(q, vectors[q], 5, float(best[-1]))
        assert again.tolist() == want.tolist()
    keep = block._survivors(vectors[0].astype(float), ids != 0, 5, float(best[-1]))
    assert keep.sum() < 600


def test_op2_against_all_scores(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert told(catalog.QUERIES["op2_topk_search"](spark, DATA)) == plain_best(rows, 50, 5)


PAGES = [
    (1, "http://bad.net/x", "<a href='http://a.com/'>"), (2, "http://A.com/q?x", "<a href=\"https://bad.net/1\"> <a href=https://b.com/>"),
    (3, "http://b.com/", "<img src='http://ok.org/fr/2'>"), (4, "http://ok.org/fr/1", "<a href='http://c.com'>"), (5, None, None),
    (6, "nourl", ""), (7, "http://c.com", ""), (8, "http://example.net/en/z#a", "x"), (9, "http://x.example.net/en", "y"),
    (9, "http://x.example.net/en", "y"), (10, "http://notnet/", None), (11, "a://b://c/d", None), (12, "http://www.a.com#x://y", None),
    (None, "http://example.com/de/", None), (14, "http://example.com?/de/", None),
]


def test_urls_rules_and_propagation(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = sorted((tuple(r) for r in urls.judge(df).collect()), key=lambda r: (r[0] or 0, r[1]))
    assert got == [
        (None, "example.com", "/de/", "example.com/de/", "block"),
        (1, "bad.net", "/x", "net/", "block"), (2, "a.com", "/q", None, "block"), (3, "b.com", "/", None, "allow"),
        (4, "ok.org", "/fr/1", "org/fr/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "c.com", "", None, "allow"), (8, "example.net", "/en/z", "example.net/en/", "allow"),
        (9, "x.example.net", "/en", "net/", "block"), (9, "x.example.net", "/en", "net/", "block"),
        (10, "notnet", "/", None, "allow"), (11, "b:", "//c/d", None, "allow"), (12, "www.a.com", "", None, "allow"),
        (14, "example.com", "", None, "allow")]
    assert urls.judge(df.limit(0)).count() == 0
    plan = urls.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_propagation_against_matrix_products(spark):
    links = [(0, 1, 3), (1, 2, 1), (2, 0, 2), (0, 3, 1), (3, 4, 5), (4, 0, 1), (5, 1, 2)]
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", n) for a, b, n in links], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h4", 1, 0), ("h2", 0, 2)], "host string, trusted long, blocked long")
    m = np.zeros((6, 6))
    for a, b, n in links:
        m[a, b] = n
    with np.errstate(invalid="ignore", divide="ignore"):
        along, against = np.nan_to_num(m / m.sum(1, keepdims=True)), np.nan_to_num(m / m.sum(0, keepdims=True))
    t0, b0 = np.array([.75, 0, 0, 0, .25, 0]), np.array([0, 0, 1., 0, 0, 0])
    t, b = t0, b0
    for _ in range(6):
        t, b = .15 * t0 + .85 * along.T @ t, .15 * b0 + .85 * against @ b
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(edges, seeds, 6).collect()}
    for h in range(6):
        assert np.allclose(got.get(f"h{h}", (0, 0)), (t[h], b[h]), atol=1e-12)


def test_propagation_ends_when_it_has_converged(spark):
    """A host twelve links above a blocked one, by links without a scheme, and the walk's fixed point."""
    pages = [(i, f"http://h{i}.com/", f"<a href=\"//h{i + 1}.com/x\">") for i in range(11)]
    pages += [(11, "http://h11.com/", "<a href=//bad.net/> <a href='/own//path'>"), (12, "http://bad.net/", ""), (13, "http://far.com/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert verdicts == {i: "allow" if i == 13 else "block" for i in range(14)}

    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1, 0), ("c", 0, 1)], "host string, trusted long, blocked long")
    along = np.array([[0, 1, 0], [.5, 0, .5], [0, 0, 0]])
    against = np.array([[0, 1, 0], [1, 0, 1], [0, 0, 0]])
    t = np.linalg.solve(np.eye(3) - .5 * along.T, .5 * np.array([1, 0, 0]))
    b = np.linalg.solve(np.eye(3) - .5 * against, .5 * np.array([0, 0, 1]))
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(edges, seeds, 20, damping=0.5).collect()}
    assert all(np.allclose(got[h], (t[k], b[k]), atol=2e-5) for k, h in enumerate("abc"))


def plain_scores(edges, seeds, damping=urls.DAMPING, rounds=400):
    """Trust and distrust of every host number, by plain sums over the links."""
    size = 1 + max(max(a, b) for a, b, _ in edges)
    src, dst, n = (np.array(x) for x in zip(*edges))
    along, against = n / np.bincount(src, n, size)[src], n / np.bincount(dst, n, size)[dst]
    t0, b0 = (np.array([seeds.get(h, (0, 0))[k] for h in range(size)], float) for k in (0, 1))
    t0, b0 = t0 / max(t0.sum(), 1), b0 / max(b0.sum(), 1)
    t, b = t0, b0
    for _ in range(rounds):
        t, b = ((1 - damping) * t0 + damping * np.bincount(dst, along * t[src], size),
                (1 - damping) * b0 + damping * np.bincount(src, against * b[dst], size))
    return t, b


def test_verdicts_against_plain_sums(spark):
    """Random links between pages whose rules make some hosts seeds."""
    rng = np.random.default_rng(9)
    names = [f"h{k}.com" if k % 9 else (f"bad{k}.net" if k % 2 else f"ok{k}.org") for k in range(60)]
    links = [(int(a), int(b), 1) for a, b in rng.integers(0, 60, (150, 2)) if a != b]
    pages = [(k, f"http://{names[k]}/fr/", "".join(f"<a href='//{names[b]}/x'>" for a, b, _ in links if a == k)) for k in range(60)]
    seeds = {k: (int(names[k].endswith(".org")), int(names[k].endswith(".net"))) for k in range(60)}
    t, b = plain_scores(links, seeds)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert all(abs(x - y) > 1e-9 or x == y for x, y in zip(t, b))
    for k in range(60):
        assert got[k] == ("block" if seeds[k][1] or (not seeds[k][0] and b[k] > t[k]) else "allow")


def test_ties_are_allowed(spark):
    """A host midway between a trusted and a blocked one, also on a cycle that never settles."""
    pages = [(1, "http://ok.org/fr/", "<a href='//mid.com'>"), (2, "http://mid.com/", "<a href='//bad.net'>"), (3, "http://bad.net/", ""),
             (4, "http://worse.com/", "<a href='//bad.net'><a href='//bad.net/2'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scores = {r["host"]: r for r in urls.propagate(
        spark.createDataFrame([("ok", "mid", 1), ("mid", "bad", 1)], "src string, dst string, n long"),
        spark.createDataFrame([("ok", 1, 0), ("bad", 0, 1)], "host string, trusted long, blocked long")).collect()}
    assert abs(scores["mid"]["trust"] - scores["mid"]["distrust"]) <= scores["mid"]["slack"] <= urls.TOLERANCE
    # With two more links to the blocked host, a third of its distrust reaches the middle.
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block"}
    edges = spark.createDataFrame([("ok", "a", 1), ("a", "b", 1), ("b", "a", 1), ("b", "bad", 1)], "src string, dst string, n long")
    again = urls.propagate(edges, spark.createDataFrame([("ok", 1, 0), ("bad", 0, 1)], "host string, trusted long, blocked long"), tolerance=1e-4)
    assert all(r["slack"] <= 1e-4 or abs(r["trust"] - r["distrust"]) > r["slack"] for r in again.collect())


def test_verdicts_do_not_depend_on_size(spark):
    """A hundred thousand hosts, whose scores are far below any bound on their sum."""
    rng = np.random.default_rng(2)
    layer = 20_000
    links = [(k, int(layer * (k // layer + 1) + rng.integers(layer)), int(rng.integers(1, 4))) for k in range(4 * layer) for _ in range(2)]
    links = [(a, b, n) for (a, b), n in {(a, b): n for a, b, n in links}.items()]
    seeds = {k: (1, 0) if k < 300 else (0, 1) for k in [*range(300), *range(5 * layer - 200, 5 * layer)]}
    t, b = plain_scores(links, seeds, rounds=8)
    edges = spark.createDataFrame([(f"h{a}", f"h{c}", n) for a, c, n in links], "src string, dst string, n long")
    given = spark.createDataFrame([(f"h{k}", *x) for k, x in seeds.items()], "host string, trusted long, blocked long")
    got = {r["host"]: r["distrust"] > r["trust"] + r["slack"] for r in urls.propagate(edges, given).collect()}
    bad = [k for k in range(len(t)) if b[k] > t[k] + 1e-12]
    assert len(bad) > 1000 and {f"h{k}" for k in bad} == {h for h, x in got.items() if x}


def test_op3_rules_against_plain(spark):
    rules = dict(urls.RULES)
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = catalog.QUERIES["op3_url_filters"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rest = pages[r["page_id"]].partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host):].split("?")[0].split("#")[0]
        fits = [k for k in rules if ("." + host).endswith("." + k.split("/")[0]) and path.startswith("/" + k.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert best is None or r["verdict"] == rules[best]
