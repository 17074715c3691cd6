"""Plain versions of what the operators compute, for comparison on small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

DATA = "/root/testdata/sf0.001"

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Texts that any operator on texts must take: (doc_id, text).
HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "word " * 20_000), (6, "word " * 20_000),
    (None, "a row without an id stands here too"), (8, "x" * 50_000), (9, "日本語 texte é ß 😀 \x1c\x85 end"),
]


def hard(spark, extra: bool = True):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    if extra:  # names that the operators use themselves
        for name in ("score", "n", "own", "token", "label", "ids", "lang", "source", "words"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text: str | None) -> list[str]:
    def valid(kind, value):
        digits = re.sub(r"[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def shingles(text: str | None, width: int = 4) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def groups(rows, percent: int = 85, width: int = 4) -> dict:
    """doc_id -> (set size, smallest id reachable), trying every pair that shares a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for a, b in {p for ids in by.values() for p in combinations(sorted(ids), 2)}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}
