"""Ordered scans against brute force, with a key that holds most rows and tied times."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators.context import rows_around, rows_around_each
from tagloom.plans import ordered
from tagloom.streaming.live import debounce_events


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice("abcdef")
        out.append((key, rng.choice([1, 1, 1, rng.randrange(50)]), i, float(rng.randrange(100))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(5)


def by_key(rows):
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_chunks_are_even_and_ordered(df, parts):
    chunks, several = ordered.chunked(df, ["k", "t", "id"], parts)
    got = chunks.orderBy("k", "t", "id").collect()
    numbers = [r["_chunk"] for r in got]
    assert numbers == sorted(numbers) and several == (parts > 1)
    assert 0.7 * parts <= len(set(numbers)) <= parts
    assert max(numbers.count(c) for c in set(numbers)) <= 3 * len(got) / parts + 1


def test_chunks_follow_from_the_rows(df, rows, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 10)
    chunks, several = ordered.chunked(df, ["k", "t", "id"])
    assert several and chunks.select("_chunk").distinct().count() > len(rows) / 20


@pytest.mark.parametrize("parts", [1, 9])
def test_with_position(df, rows, parts):
    got = ordered.with_position(df, ["k", "t", "id"], start=10, parts=parts).collect()
    want = {r[2]: i + 10 for i, r in enumerate(sorted(rows))}
    assert {r["id"]: r["pos"] for r in got} == want


@pytest.mark.parametrize("parts", [1, 9])
def test_running_max(df, rows, parts):
    got = {r["id"]: r["m"] for r in ordered.running_max(df, ["k"], ["t", "id"], "v", "m", parts).collect()}
    want = {}
    for group in by_key(rows).values():
        top = None
        for row in group:
            top = row[3] if top is None else max(top, row[3])
            want[row[2]] = top
    assert got == want


@pytest.mark.parametrize("parts", [1, 9])
def test_with_next(df, rows, parts):
    got = {r["id"]: r["n"] for r in ordered.with_next(df, ["k"], ["t", "id"], "v", "n", parts).collect()}
    want = {}
    for group in by_key(rows).values():
        for row, following in zip(group, group[1:] + [None]):
            want[row[2]] = following and following[3]
    assert got == want


@pytest.mark.parametrize("parts, alpha", [(1, 0.5), (9, 0.5), (9, 0.1)])
def test_moving_average(df, rows, parts, alpha):
    got = {r["k"]: (r["ema"], r["n"]) for r in
           ordered.moving_average(df, ["k"], ["t", "id"], "v", alpha, parts=parts).collect()}
    for key, group in by_key(rows).items():
        state = group[0][3]
        for row in group:
            state = state * (1 - alpha) + alpha * row[3]
        assert got[key] == (pytest.approx(state), len(group))


def test_two_part_keys(df, rows):
    two = df.withColumn("k2", F.col("id") % 2)
    got = {r["id"]: r["m"] for r in ordered.running_max(two, ["k", "k2"], ["t", "id"], "v", "m", 9).collect()}
    want = {}
    for parity in (0, 1):
        for group in by_key([r for r in rows if r[2] % 2 == parity]).values():
            top = 0
            for row in group:
                top = max(top, row[3])
                want[row[2]] = top
    assert got == want


def test_rows_around_on_sparse_keys(spark):
    keys = sorted(random.Random(3).sample(range(10_000), 200))
    table = spark.createDataFrame([(k,) for k in keys], "tid bigint")
    at = 90
    got = [r["tid"] for r in rows_around(table, keys[at]).collect()]
    assert got == keys[at - 16:at + 17][::-1]
    anchors = [keys[0], keys[50], keys[199], 10_001]
    pairs = rows_around_each(table, spark.createDataFrame([(k,) for k in anchors], "tid bigint"), parts=6).collect()
    for anchor in anchors[:3]:
        i = keys.index(anchor)
        assert sorted(r["tid"] for r in pairs if r["anchor"] == anchor) == keys[max(0, i - 16):i + 17]
    assert not [r for r in pairs if r["anchor"] == 10_001]
    assert [r["tid"] for r in rows_around(table, keys[at], 1).collect()] == keys[at - 1:at + 2][::-1]


def test_debounce(spark):
    events = spark.createDataFrame(
        [("a", 0, 1, "x"), ("a", 300, 2, "xy"), ("a", 700, 3, "xyz"), ("a", 900, 4, ""), ("a", 1000, 5, "q"), ("b", 0, 6, "z")],
        "key string, ms int, id int, value string")
    events = events.withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    for parts in (1, 4):
        got = sorted(r["id"] for r in debounce_events(events, parts=parts).collect())
        assert got == [2, 4, 5, 6]


@pytest.mark.parametrize("parts", [1, 9])
def test_running_sum(df, rows, parts):
    whole = df.withColumn("n", F.col("v").cast("bigint"))
    got = {r["id"]: r["s"] for r in ordered.running_sum(whole, ["k"], ["t", "id"], "n", "s", parts).collect()}
    want = {}
    for group in by_key(rows).values():
        total = 0
        for row in group:
            want[row[2]] = total
            total += int(row[3])
    assert got == want


def test_a_null_key_may_be_the_hot_one(df, rows):
    nulled = df.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    chunks, _ = ordered.chunked(nulled, ["k", "t", "id"], 9)
    assert chunks.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] < len(rows) / 3
    top = {r["id"]: r["m"] for r in ordered.running_max(nulled, ["k"], ["t", "id"], "v", "m", 9).collect()}
    nxt = {r["id"]: r["n"] for r in ordered.with_next(nulled, ["k"], ["t", "id"], "v", "n", 9).collect()}
    ema = {r["k"]: r["ema"] for r in ordered.moving_average(nulled, ["k"], ["t", "id"], "v", parts=9).collect()}
    group = by_key(rows)["hot"]
    high, state = group[0][3], group[0][3]
    for row, following in zip(group, group[1:] + [None]):
        high, state = max(high, row[3]), (state + row[3]) / 2
        assert top[row[2]] == high and nxt[row[2]] == (following and following[3])
    assert ema[None] == pytest.approx(state)
    two = nulled.withColumn("k2", F.lit(None).cast("int"))
    again = {r["id"]: r["m"] for r in ordered.running_max(two, ["k", "k2"], ["t", "id"], "v", "m", 9).collect()}
    assert again == top


@pytest.mark.parametrize("parts", [1, 9])
def test_running(spark, rows, parts):
    df = spark.createDataFrame([(k, t, i, int(v), int(v) * 7 + i) for k, t, i, v in rows], "k string, t int, id int, s long, x long")
    got = {r["id"]: (r["s"], r["x"]) for r in ordered.running(
        df, ["k"], ["t", "id"], {"s": ordered.SUM, "x": ordered.XOR}, parts).collect()}
    want = {}
    for group in by_key(rows).values():
        total = mixed = 0
        for _, _, i, v in group:
            total, mixed = total + int(v), mixed ^ (int(v) * 7 + i)
            want[i] = total, mixed
    assert got == want
