import hashlib
import random
import zlib

import numpy as np
import pytest

from tagloom.llm import prefixes
from tagloom.plans import ordered

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(row):
    turn, role, text = row
    told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    return turn is not None, turn or 0, role.encode(), told


def plain(rows):
    """Node (smallest member, depth) -> all other columns, by walking every sequence."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    told = {c: [(r, t) for _, r, t in sorted(v, key=turn_key)] for c, v in convs.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(np.fmod(c, 100))
        built[c] = tuple(told.get(head, [])[:h] + own[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out[min(members), len(path)] = (
            min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in (
        "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed):
    """Few texts, so that much is shared; copies, heads that are missing, negative ids, long ones."""
    rng = random.Random(seed)
    rows = []
    ids = [*range(0, 40), *range(-30, -3, 5), *range(100, 130), *range(250, 262), 10**12, 10**12 + 7]
    for c in ids:
        if rng.random() < 0.3:  # a copy of one conversation
            turns = [(t, "user", f"same {t}") for t in range(4)]
        else:
            turns = [(t, rng.choice(["user", "user", None, ""]), rng.choice(["a", "b é😀", None, "", f"own {c}"])) for t in range(rng.randint(1, 7))]
        rows += [(c, *t) for t in turns]
    rows += [(3, None, "user", "no number"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (5, 2, None, None), (None, 1, "user", "no id")]
    rows += [(77, t, "user", f"long {t % 3}") for t in range(60)] + [(78, t, "user", f"long {t % 3}") for t in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells, chunk", [(1 << 20, 65_536), (8, 65_536), (1 << 20, 40)])
def test_trie_against_plain(spark, monkeypatch, cells, chunk):
    """Also with a sketch that is nearly full, and with chunks that cut conversations and ends."""
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", chunk)
    monkeypatch.setattr(prefixes, "BLOCK", 16 if cells == 8 else prefixes.BLOCK)
    rows = conversations(len(str(cells)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefixes.trie(df, cells)) == plain(rows)


def test_sketch_that_proves_a_parent_single_but_not_its_child(spark, monkeypatch):
    """Long conversations of their own turns, with a cell or two a prefix."""
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(c, t, "user", f"own {rng.randrange(10**9)}" if t > 1 else f"shared {rng.randrange(2)}") for c in range(1, 31) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefixes.trie(df, 256)) == plain(rows)


def test_estimates_are_never_too_low(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 60, (2, 4000))
    twice = np.arange(0, 4000, 10)
    rows = [(int(x), int(y)) for x, y in zip(np.append(a, a[twice]), np.append(b, b[twice]))]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    sketch = prefixes.sketch_of(df, len(rows))
    flagged = sketch.possibly_shared(a, b)
    assert flagged[twice].all()
    assert flagged.sum() < len(twice) + 400  # most single ones are proven single
    full = prefixes.sketch_of(df, len(rows), 1024)
    assert full.possibly_shared(a, b)[twice].all()


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(none).count() == 0
    assert prefixes.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "x" * 30_000), (1, 1, "user", ""), (2, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("a", "b", "pa", "at", "told", "size", "row", "depth", "head", "length", "maybe", "n_convs"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert got(prefixes.trie(df)) == plain(rows)
