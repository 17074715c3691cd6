"""N-gram Jaccard join by prefixes under several global token orders.

Two documents whose shingle sets are similar enough share a token in their prefixes under
*every* total order of the tokens. Candidates must do so under three orders, all with
rare tokens first: by exact document frequency, by its power of two, and by whether it is
one, each with a hash of its own to break ties. A token that only one text has can match
nothing, so a text without enough shared tokens leaves at once; what is left of the
others (their shared tokens) is all that the verification needs.

Steps: (1) one pass over the texts turns them into sets of 64-bit shingle hashes; texts
with equal sets are one class from here on. (2) Hashes travel once, packed by range, to
count in how many classes each occurs; those met twice go back to their class. Hashes
that many texts of one task share are counted there and join through a table of counts,
which Spark can split, so that no task gets all texts of a hot passage. (3) Prefixes;
lists by prefix token of the first order. (4) Of each list, first a star around its text
with the fewest tokens of its own, then around a random one: groups of near copies become
one component without all their pairs. (5) Of lists that still hold several components,
the pairs across them, cut by length and position. Every pair is checked on the other
orders and then exactly. (6) Components.

Hashes have 64 bits: among 10^9 different shingles or classes a collision has a chance
of about 3 in 100.

Defined results: null and empty texts, and texts of white space, have an empty set and
are linked with nothing; a text of fewer words than a shingle is one shingle; repeated
rows are one class; extra columns are not read; a row with a null id takes part in its
class but names no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import through_table
from .common import WordTable, held, mix, ship, text_of, text_slices, tidy
from .components import components

BLOCK = 1_000_000  # hashes that a task holds before it passes them on
HOT = 256  # texts of one block that share a hash before it is counted apart

PACKED = ("kind int, part int, doc_id long, own long, n int, owners binary, sizes binary, totals binary, "
          "tokens binary, counts binary, hot array<long>")
FOUND = ("kind int, part int, doc_id long, own long, n int, token long, df long, owners binary, sizes binary, "
         "totals binary, tokens binary, counts binary, hot array<long>")
SETS = "own long, n int, m int, tokens array<long>, first array<long>, second array<long>, third array<long>"


def _hash_words(words: list[bytes]):
    return [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))]


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    split = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    table = held("shingles", lambda: WordTable(_hash_words))
    at = table.index([w for words in split for w in words])
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = table.column(0)[at]
    rolled = hashes[:max(0, len(hashes) - width + 1)]
    for k in range(1, width):
        rolled = mix(rolled, hashes[k:len(hashes) - width + 1 + k])
    out, begin = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[begin:begin + n - width + 1]))
        elif n:
            whole = hashes[begin:begin + 1] ^ np.uint64(n)
            for k in range(1, n):
                whole = mix(whole, hashes[begin + k:begin + k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        begin += n
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


_PACKED = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int32()),
    ("owners", pa.binary()), ("sizes", pa.binary()), ("totals", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary()),
    ("hot", pa.list_(pa.int64()))])


def _pack(owners: list[int], sets: list[np.ndarray], parts: int, most: int) -> Iterator[dict]:
    """Rows of one block: hashes by range with their owners, counts of hot ones, hot ones by owner."""
    owner = np.array(owners, np.int64)
    total = np.fromiter(map(len, sets), np.int32, len(sets))
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), total)
    part = (tokens % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((tokens, part))
    ordered = tokens[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    runs = np.diff(np.append(starts, len(ordered)))
    hot = np.zeros(len(tokens), bool)
    hot[order] = np.repeat(runs > most, runs)
    if hot.any():
        names, counts = ordered[starts][runs > most], runs[runs > most]
        for p in np.unique(names % np.uint64(parts)):
            own = names % np.uint64(parts) == p
            yield {"kind": 2, "part": int(p), "tokens": names[own].tobytes(), "counts": counts[own].astype(np.int64).tobytes()}
        for own in np.split(np.flatnonzero(hot), np.flatnonzero(np.diff(of[hot])) + 1):
            i = int(of[own[0]])
            yield {"kind": 3, "part": int(owner[i] % parts), "own": int(owner[i]), "n": int(total[i]), "hot": tokens[own].astype(np.int64).tolist()}
    by = np.argsort(part[~hot], kind="stable")
    rest, rest_of, rest_part = tokens[~hot][by], of[~hot][by], part[~hot][by]
    edges = np.searchsorted(rest_part, np.arange(parts + 1))
    for p in range(parts):
        a, b = int(edges[p]), int(edges[p + 1])
        if a < b:
            here = rest_of[a:b]
            firsts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            yield {"kind": 1, "part": p, "owners": owner[here[firsts]].tobytes(),
                   "sizes": np.diff(np.append(firsts, b - a)).astype(np.int32).tobytes(),
                   "totals": total[here[firsts]].tobytes(), "tokens": rest[a:b].tobytes()}


def _sets_of(width: int, parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        owners, sets, held = [], [], 0
        for batch in batches:
            for some, texts in text_slices(batch):
                rows = []
                for doc_id, own_set in zip(some.column("doc_id").to_pylist(), shingle_sets(texts, width)):
                    row = {"kind": 0, "part": 0, "doc_id": doc_id, "n": len(own_set)}
                    if len(own_set):
                        own = xxhash.xxh3_64_intdigest(own_set.tobytes()) >> 1
                        row |= {"own": own, "part": own % parts}
                        if own not in seen:
                            seen.add(own)
                            owners.append(own)
                            sets.append(own_set)
                            held += len(own_set)
                    rows.append(row)
                yield _batch(rows, _PACKED)
                if held >= BLOCK:
                    for row in _pack(owners, sets, parts, hot):
                        yield _batch([row], _PACKED)
                    owners, sets, held = [], [], 0
        if held:
            for row in _pack(owners, sets, parts, hot):
                yield _batch([row], _PACKED)
    return run


_FOUND = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int32()), ("token", pa.int64()),
    ("df", pa.int64()), ("owners", pa.binary()), ("sizes", pa.binary()), ("totals", pa.binary()), ("tokens", pa.binary()),
    ("counts", pa.binary()), ("hot", pa.list_(pa.int64()))])


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _counted(parts: int):
    """A range of hashes: how many classes have each; those of several go back, packed by range of classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, sizes, totals, tokens, names, counts = [], [], [], [], [], []
        for batch in batches:
            passed = []
            for row in batch.to_pylist():
                if row["kind"] in (0, 3):
                    passed.append(row)
                elif row["kind"] == 2:
                    names.append(np.frombuffer(row["tokens"], np.uint64))
                    counts.append(np.frombuffer(row["counts"], np.int64))
                else:
                    owners.append(np.frombuffer(row["owners"], np.int64))
                    sizes.append(np.frombuffer(row["sizes"], np.int32))
                    totals.append(np.frombuffer(row["totals"], np.int32))
                    tokens.append(np.frombuffer(row["tokens"], np.uint64))
            if passed:
                yield _batch(passed, _FOUND)
        hot, inverse = np.unique(_joined(names, np.uint64), return_inverse=True)
        hot_df = np.bincount(inverse, _joined(counts), len(hot)).astype(np.int64)
        owner, size, total, token = _joined(owners), _joined(sizes), _joined(totals), _joined(tokens, np.uint64)
        # Copies of a class from several tasks: the first counts.
        one = np.zeros(len(owner), bool)
        one[np.unique(owner, return_index=True)[1]] = True
        token = token[np.repeat(one, size)]
        of = np.repeat(np.flatnonzero(one), size[one])
        if len(token):
            order = np.argsort(token, kind="stable")
            token, of = token[order], of[order]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            runs = np.diff(np.append(starts, len(token)))
            df = runs.copy()
            if len(hot):
                at = np.searchsorted(hot, token[starts]).clip(0, len(hot) - 1)
                both = hot[at] == token[starts]
                hot_df[at[both]] += runs[both]
                df[both] = hot_df[at[both]]
            keep = np.repeat(df > 1, runs)
            token, df, of = token[keep], np.repeat(df, runs)[keep], of[keep]
            part = owner[of] % parts
            order = np.lexsort((of, part))
            token, df, of, part = token[order], df[order], of[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in np.unique(part).tolist():
                a, b = int(edges[p]), int(edges[p + 1])
                firsts = np.flatnonzero(np.append(True, of[a + 1:b] != of[a:b - 1]))
                who = of[a:b][firsts]
                yield _batch([{
                    "kind": 1, "part": p, "owners": owner[who].tobytes(), "totals": total[who].astype(np.int32).tobytes(),
                    "sizes": np.diff(np.append(firsts, b - a)).astype(np.int32).tobytes(),
                    "tokens": token[a:b].tobytes(), "counts": df[a:b].tobytes()}], _FOUND)
        if len(hot):
            yield _batch([{"kind": 2, "token": t, "df": d} for t, d in zip(hot.astype(np.int64).tolist(), hot_df.tolist())], _FOUND)
    return run


def needed(n, percent: int):
    """Tokens that a set of ``n`` must share with any similar set."""
    return (percent * n + 99) // 100


def prefixes(n: int, tokens: np.ndarray, dfs: np.ndarray, percent: int) -> list[np.ndarray]:
    """Shared tokens within the prefix, under each order; the n - m unshared ones come first."""
    room = n - needed(n, percent) + 1 - (n - len(tokens))
    names = tokens.astype(np.uint64)
    levels = (dfs, np.log2(dfs).astype(np.int64), np.zeros(len(dfs), np.int64))
    return [tokens[np.lexsort((mix(names, np.full(len(names), k + 1, np.uint64)), level))[:max(0, room)]]
            for k, level in enumerate(levels)]


def _prefixed(percent: int):
    """A range of classes: the shared tokens and the prefixes of those with enough of them."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4]
    names = ["own", "n", "m", "tokens", "first", "second", "third"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, totals, tokens, counts = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    sizes = np.frombuffer(row["sizes"], np.int32)
                    owners.append(np.repeat(np.frombuffer(row["owners"], np.int64), sizes))
                    totals.append(np.repeat(np.frombuffer(row["totals"], np.int32), sizes))
                    tokens.append(np.frombuffer(row["tokens"], np.int64))
                    counts.append(np.frombuffer(row["counts"], np.int64))
                else:
                    owners.append(np.array([row["own"]]))
                    totals.append(np.array([row["n"]], np.int32))
                    tokens.append(np.array([row["token"]]))
                    counts.append(np.array([row["df"]]))
        owner, total, token, df = _joined(owners), _joined(totals, np.int32), _joined(tokens), _joined(counts)
        order = np.lexsort((token, owner))
        # A copy in another block may bring a token twice.
        new = np.append(True, (owner[order][1:] != owner[order][:-1]) | (token[order][1:] != token[order][:-1]))[:len(order)]
        order = order[new]
        owner, total, token, df = owner[order], total[order], token[order], df[order]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[:len(owner)]
        stops = np.append(starts[1:], len(owner))
        enough = np.flatnonzero(stops - starts >= needed(total[starts].astype(np.int64), percent))
        for k in range(0, len(enough), 2000):
            rows = []
            for i in enough[k:k + 2000]:
                a, b = starts[i], stops[i]
                n = int(total[a])
                rows.append((int(owner[a]), n, int(b - a), token[a:b], *prefixes(n, token[a:b], df[a:b], percent)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(zip(*rows), kinds)], names)
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share prefix tokens under the other orders and are similar."""
    side = lambda x: sets.select(*(F.col(c).alias(f"{x}_{c}") for c in ("own", "n", "tokens", "second", "third")))
    joined = (pairs.join(side("a"), F.col("a") == F.col("a_own")).join(side("b"), F.col("b") == F.col("b_own"))
              .where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return joined.where(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def _pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def similar(docs: DataFrame, width: int = 4, percent: int = 85, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row.

    ``hot``: texts of one block from which a shared hash is counted apart.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = rows.mapInArrow(_sets_of(width, parts, hot), PACKED)
    found = through_table(packed.repartitionById(parts, F.col("part")).mapInArrow(tidy(_counted(parts)), FOUND), "shingles")

    members = found.where("kind = 0").select("doc_id", "own", F.col("n").cast("long").alias("n_shingles"))
    counted = found.where("kind = 2").select("token", "df")
    held = found.where("kind = 3").select("part", "own", "n", F.explode("hot").alias("token"))
    of_hot = held.distinct().join(counted, "token").selectExpr("3 AS kind", "part", "own", "n", "token", "df")
    back = found.where("kind = 1").unionByName(of_hot, allowMissingColumns=True)
    sets = through_table(back.repartitionById(parts, F.col("part")).mapInArrow(tidy(_prefixed(percent)), SETS), "prefixes")

    lists = through_table(sets.select("own", "n", "m", F.posexplode("first").alias("pos", "token")), "lists")
    fits = lambda a, b: F.least(a, b) * 100 >= percent * F.greatest(a, b)

    def star(lists: DataFrame, rank) -> DataFrame:
        """Pairs of each list's least text by ``rank`` with the others."""
        middle = lists.groupBy("token").agg(F.min(F.struct(rank.alias("r"), "own", "n", "label")).alias("c"),
                                            F.min("label").alias("low"), F.max("label").alias("high"))
        middle = middle.where("low <> high").select("token", "c")
        return (lists.join(middle, "token").where((F.col("label") != F.col("c.label")) & fits(F.col("n"), F.col("c.n")))
                .select(*_pair("own", "c.own")).distinct())

    alone = lists.withColumn("label", F.col("own"))
    edges = through_table(_verified(star(alone, F.col("n") - F.col("m")), sets, percent), "links")

    def labelled(edges: DataFrame) -> DataFrame:
        known = components(edges)
        return lists.join(known, lists.own == known.node, "left").select(
            "own", "n", "m", "pos", "token", F.coalesce("label", "own").alias("label"))

    more = through_table(_verified(star(labelled(edges), F.xxhash64("own")), sets, percent), "links")
    edges = edges.union(more)
    left = labelled(edges)
    mixed = left.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    left = through_table(left.join(mixed, "token", "left_semi"), "lists")
    x, y = left.alias("x"), left.alias("y")
    # What a pair can still share from its first common token on; unshared tokens stand before it.
    rest = lambda s: F.col(f"{s}.m") - F.col(f"{s}.pos")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.own") < F.col("y.own"))
                    & (F.col("x.label") != F.col("y.label")) & fits(F.col("x.n"), F.col("y.n"))
                    & (F.least(rest("x"), rest("y")) * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))))
    last = through_table(_verified(across.select(*_pair("x.own", "y.own")).distinct(), sets, percent), "links")
    linked = components(edges.union(last))

    classes = members.where("own IS NOT NULL").groupBy("own").agg(F.min("doc_id").alias("least"))
    named = linked.join(classes, linked.node == classes.own)
    smallest = named.groupBy("label").agg(F.min("least").alias("smallest"))
    ids = classes.join(named.join(smallest, "label").select(F.col("own").alias("of"), "smallest"), F.col("own") == F.col("of"), "left").select(
        F.col("own").alias("of"), F.coalesce("smallest", "least").alias("smallest"))
    return members.join(ids, members.own == ids.of, "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with their columns.

    Rows that share an id are one document; rows with a null id stay. Texts cross the
    network once, hashed by id, and meet a narrow table of ids.
    """
    kept = similar(docs, width, percent).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("llm_kept")).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("llm_kept")), "left_semi")
