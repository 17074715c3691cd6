"""Personal data: base expressions, and identifiers that learned contexts discover.

Everything is DataFrame functions. The base kinds are regular expressions, each written
so that a run of characters is tried from its start alone (or from where the last match
ended), and repeated groups never give back what they took. Places come from the texts
between matches, whose lengths are summed up in two levels; overlaps are found by halving,
and texts are cut by place in their four-byte form. So a text of n matches costs about
n * 128 small steps, not n * n: 200,000 numbers in one text take seconds.

Discovery bootstraps from the base entities, the seeds. The word before some distinct
identifiers is a pattern for their kind. Patterns and instances (seeds, and tokens shaped
like an identifier that no base expression takes) form a graph that is scored in rounds: a
pattern by the confidence of the instances after it, over *all* places of its word in the
corpus; an instance by the patterns before it. Instances of high confidence are identifiers
too: they induce further patterns, which are scored in turn, until no pattern and no
identifier is new. What follows a pattern of high confidence is added. A word that stands
before identifiers by chance has many other places and scores low.

Defined results: a null text is the empty text; documents without personal data have
counts 0 and empty spans; equal rows give equal results; extra columns are not read by
``find`` and pass through ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import let, running_starts
from ..plans.shared import through_table
from .common import text_of

# Kinds in their order, and what each base expression takes.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character without which a kind cannot occur: spares the expression.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

# Tokens with a digit or an @, as discovery may add them, and their shapes.
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
SHAPES = {
    "email": r"^[\p{L}0-9._%+-]+@[\p{L}0-9._-]+$",
    "ip": r"^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}$",
    "card": r"^[0-9](?:-?[0-9]){12,18}$",
    "phone": r"^\(?[0-9](?:[().-]{0,2}[0-9]){6,14}$",
}
ROUNDS = 3  # of scores, each time that patterns are induced
SEEDS = 3  # distinct identifiers that a pattern must have
CONFIDENT = 0.5

SPAN = "struct<kind:int,start:int,stop:int,value:string,before:string>"


def _last_word(gap: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(gap, F.lit(64)), r"(\S+)\s*$", 1))


def _places(text: Column, pattern: str, kind: Column) -> Column:
    """Every match with its place (code points, end exclusive) and the word before it."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(between, found, lambda g, m: F.struct(
        F.length(g).alias("g"), F.length(m).alias("m"), m.alias("value"), _last_word(g).alias("before"))),
        lambda x: x["value"].isNotNull())

    def placed(xs: Column) -> Column:
        starts = running_starts(F.transform(xs, lambda x: x["g"] + x["m"]))
        return F.zip_with(xs, starts, lambda x, s: F.struct(
            kind.alias("kind"), (s + x["g"]).cast("int").alias("start"), (s + x["g"] + x["m"]).cast("int").alias("stop"),
            x["value"].alias("value"), x["before"].alias("before")))

    return F.coalesce(let(pairs, placed), F.expr(f"CAST(array() AS array<{SPAN}>)"))


def _valid(kind: str):
    """The test that a match must pass."""
    def test(x: Column) -> Column:
        value = x["value"]
        if kind == "ip":
            return value.rlike(OCTETS)
        digits = F.regexp_replace(value, r"[^0-9]", "")
        if kind == "card":
            return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
        return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)
    return test


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, stop, value, before>> of the base kinds, by kind and start."""
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    parts = []
    for number, kind in enumerate(KINDS):
        found = F.filter(_places(text, BASE[kind], F.lit(number)), _valid(kind))
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if NEEDS[kind] else
                     F.when(text.rlike("[0-9]"), found).otherwise(none))
    return F.concat(*parts)


def token_spans(text: Column) -> Column:
    """Tokens shaped like an identifier, without the marks around them; of each its kinds."""
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    cleaned = F.transform(F.when(text.rlike("[0-9@]"), _places(text, TOKEN, F.lit(-1))).otherwise(none), lambda x: F.struct(
        x["start"].alias("start"), F.length(F.regexp_extract(x["value"], r"^[^\p{L}0-9(:]*", 0)).alias("cut"),
        F.regexp_replace(x["value"], r"^[^\p{L}0-9(:]+|[^\p{L}0-9:]+$", "").alias("value"), x["before"].alias("before")))

    def of(placed: Column, number: int, kind: str) -> Column:
        shaped = F.filter(placed, lambda x: x["value"].rlike(SHAPES[kind]))
        return F.transform(shaped, lambda x: F.struct(
            F.lit(number).alias("kind"), (x["start"] + x["cut"]).alias("start"),
            (x["start"] + x["cut"] + F.length(x["value"])).alias("stop"), x["value"].alias("value"), x["before"].alias("before")))

    return let(cleaned, lambda placed: F.concat(*(of(placed, number, kind) for number, kind in enumerate(KINDS))))


def _overlaps(ordered: Column, x: Column) -> Column:
    """Whether one of the spans, which are in order and apart, overlaps ``x``: found by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    before = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(ordered)) & (F.get(ordered, at + step - 1)["start"] < x["stop"]), at + step).otherwise(at))
    return F.when(F.size(ordered) == 0, False).otherwise(
        let(before, lambda n: (n > 0) & (F.get(ordered, n - 1)["stop"] > x["start"])))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, tokens of every row, as a table without the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    spans = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base"),
                        token_spans(F.col("text")).alias("found"))
    # Spans of one kind never overlap one another.
    of_kind = {f"k{n}": F.filter("base", lambda b, n=n: b["kind"] == n) for n in range(len(KINDS))}
    inside = lambda x: reduce(lambda a, b: a | b, (_overlaps(F.col(k), x) for k in of_kind))
    tokens = F.when(F.size("base") == 0, F.col("found")).otherwise(F.filter("found", lambda x: ~inside(x)))
    return through_table(spans.withColumns(of_kind).select("doc_id", "text_hash", "base", tokens.alias("tokens")), "spans")


def patterns(spans: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """before, kind, confidence: patterns of the pattern-instance graph when nothing new is induced.

    Texts are read once more to count all places of the words that may become patterns;
    words are counted where they lie before they meet those.
    """
    one = lambda column, seed: spans.select(F.explode(column).alias("s")).select(
        F.col("s.before").alias("before"), F.col("s.kind").alias("kind"), F.lower("s.value").alias("value"), F.lit(seed).alias("seed"))
    graph = (one("base", 1.0).union(one("tokens", 0.0)).where("before <> ''").groupBy("before", "kind", "value")
             .agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    graph = through_table(graph, "graph")
    able = graph.groupBy("before", "kind").agg(F.count("*").alias("values")).where(F.col("values") >= SEEDS)
    spoken = docs.select(F.explode(F.split(F.lower(text_of()), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("places"))
    able = able.join(spoken, able.before == spoken.word).select("before", "kind", "places")
    edges = through_table(graph.join(able, ["before", "kind"]), "edges")
    sure = through_table(edges.groupBy("kind", "value").agg(F.max("seed").alias("c")), "sure")
    many = sure.where(F.col("c") >= CONFIDENT).count()
    while True:
        known = edges.join(sure.where(F.col("c") >= CONFIDENT), ["kind", "value"]).groupBy("before", "kind").agg(
            F.count("*").alias("m")).where(F.col("m") >= SEEDS).select("before", "kind")
        own = through_table(edges.join(known, ["before", "kind"], "left_semi"), "patterns")
        confidence, scored = sure, None
        for _ in range(rounds):
            scored = own.join(confidence, ["kind", "value"]).groupBy("before", "kind").agg(
                F.least(F.lit(1.0), F.sum(F.col("c") * F.col("n")) / F.max("places")).alias("confidence"))
            scored = through_table(scored, "scored")
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
            confidence = own.join(scored, ["before", "kind"]).groupBy("kind", "value").agg(
                F.greatest(F.max("seed"), 1 - doubt).alias("c"))
        # Identifiers stay what they are, so each turn has more of them or is the last.
        sure = through_table(sure.union(confidence).groupBy("kind", "value").agg(F.max("c").alias("c")), "sure")
        had, many = many, sure.where(F.col("c") >= CONFIDENT).count()
        if many == had:
            return scored


def discovered(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, added: the tokens after patterns of high confidence."""
    good = patterns(spans, docs).where(F.col("confidence") >= CONFIDENT).select("before", "kind")
    tokens = spans.select("doc_id", "text_hash", F.explode("tokens").alias("s")).select(
        "doc_id", "text_hash", "s", F.col("s.before").alias("before"), F.col("s.kind").alias("kind"))
    return tokens.join(good, ["before", "kind"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, added of every row; spans are (kind, start, stop, value, before)."""
    spans = extracted(docs)
    more = discovered(spans, docs).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    return spans.join(more, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left").select(
        "doc_id", "base", F.coalesce("added", F.expr(f"CAST(array() AS array<{SPAN}>)")).alias("added"))


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _latest(values: Column, step: int = 256) -> Column:
    """The largest of all earlier values, at least 0, for each; in two levels, as ``running_starts``."""
    top = lambda xs: F.coalesce(F.array_max(xs), F.lit(0))

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / step).cast("int")),
                             lambda b: top(F.slice(xs, b * step + 1, F.lit(step))))
        tops = let(blocks, lambda bs: F.transform(bs, lambda _, i: top(F.slice(bs, F.lit(1), i))))
        return let(tops, lambda bs: F.transform(xs, lambda _, i: F.greatest(
            F.get(bs, (i / step).cast("int")), top(F.slice(xs, (i / step).cast("int") * step + 1, i % step)))))

    return let(values, of)


def _tagged(text: Column, spans: Column) -> Column:
    """``text`` with a tag in place of each of ``spans``, one at least, in order; of overlapping ones the first.

    Places are cut from four bytes a letter, where every place is found at once.
    """
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    stops = lambda xs: F.transform(xs, lambda x: x["stop"])
    cut = lambda b, start, stop: F.decode(F.substring(b, start * 4 + 1, (stop - start) * 4), "UTF-32")

    def build(p: Column) -> Column:
        kept = F.filter(F.zip_with(p["spans"], _latest(stops(p["spans"])), lambda x, at: F.struct(
            x["start"].alias("start"), at.alias("at"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["at"])
        pieces = F.transform(kept, lambda x: F.concat(cut(p["wide"], x["at"], x["start"]), F.get(tags, x["kind"])))
        return F.concat(F.array_join(pieces, ""), cut(p["wide"], F.array_max(stops(p["spans"])), F.length(text)))

    return let(F.struct(spans.alias("spans"), F.encode(text, "UTF-32").alias("wide")), build)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with a tag in place of each span; ``n_chars``, where there is one, follows.

    Texts stay where they are unless more is discovered than Spark broadcasts.
    """
    more = discovered(extracted(docs), docs).select(
        F.col("doc_id").alias("llm_id"), F.col("text_hash").alias("llm_hash"), F.col("added").alias("llm_added"))
    text = text_of()
    rows = docs.join(more, F.col("doc_id").cast("long").eqNullSafe(F.col("llm_id")) & (F.xxhash64(text) == F.col("llm_hash")), "left")
    by_start = F.array_sort(F.transform(F.concat(base_spans(text), F.coalesce("llm_added", F.expr(f"CAST(array() AS array<{SPAN}>)"))),
                                        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    rows = rows.withColumn("llm_spans", by_start)
    clean = F.when(F.size("llm_spans") > 0, _tagged(F.col("text"), F.col("llm_spans"))).otherwise(F.col("text"))
    out = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("llm_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
