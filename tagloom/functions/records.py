"""Markdown segments and outlines of nested records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let, running_starts

# Line kinds and the patterns that tell them, first match wins.
LINE_KINDS = [
    ("code", r"^(```|~~~| {4}|\t)"),
    ("heading", r"^ {0,3}#{1,6}(\s|$)"),
    ("listItem", r"^\s*([-*+]|\d+[.)])\s"),
    ("blockquote", r"^ {0,3}>"),
    ("html", r"^\s*</?[A-Za-z!]"),
    ("link", r"^\s*\[[^\]]+\]\([^)]+\)\s*$"),
]
DEFAULT_KIND = "paragraph"


def line_segments(text: Column) -> Column:
    """Lines with their line ends: array of struct(start, seg, kind), without gaps.

    An empty text is one empty line. Everything happens inside the row, so a document is cut without a shuffle.
    """
    def cut(segs: Column) -> Column:
        starts = running_starts(F.transform(segs, F.length))
        return F.transform(F.arrays_zip(starts.alias("start"), segs.alias("seg")), lambda p: F.struct(
            p["start"].alias("start"), p["seg"].alias("seg"), line_kind(p["seg"]).alias("kind")))

    lines = F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))
    return let(F.when(text == "", F.array(F.lit(""))).otherwise(lines), cut)


def line_kind(seg: Column) -> Column:
    kind = None
    for name, pattern in LINE_KINDS:
        hit = F.rlike(seg, F.lit(pattern))
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    return kind.otherwise(F.lit(DEFAULT_KIND))


def segment_tags(kind: Column, seg: Column, seq: Column, start: Column) -> Column:
    """Attributes of a segment as tags: kind with a serial, place, parent, value, url, lang, level."""
    body = F.regexp_replace(seg, r"\n$", "")
    value = F.regexp_replace(body, r"^\s*(#{1,6}|[-*+]|\d+[.)]|>)\s*", "")
    url = F.regexp_extract(body, r"\]\(([^)]+)\)", 1)
    lang = F.regexp_extract(body, r"^(?:```|~~~)\s*(\w+)", 1)
    level = F.length(F.regexp_extract(body, r"^ {0,3}(#{1,6})(?:\s|$)", 1))
    serial = F.lower(F.conv((seq + 1).cast("string"), 10, 36))
    parts = F.array(
        F.concat(F.lit("#"), kind, F.lit(";"), kind, F.lit("_"), serial),
        F.concat(F.lit("#ref="), kind),
        F.concat(F.lit("#seq="), start.cast("string")),
        F.lit("#parent=root"),
        F.when(value != "", F.concat(F.lit("#val="), value)),
        F.when(url != "", F.concat(F.lit("#meta=url:"), url)),
        F.when(lang != "", F.concat(F.lit("#meta=lang:"), lang)),
        F.when(level > 0, F.concat(F.lit("#meta=level:"), level.cast("string"))),
    )
    return F.filter(parts, lambda p: p.isNotNull())


def outline(record: Column, depth: int = 4) -> Column:
    """Nested JSON text -> indented bullet list, keys in the order they are written.

    Levels below ``depth`` are shown as JSON text, a text that is not JSON as it is.
    """
    return _outline(record, F.try_parse_json(record), F.lit(""), depth)


def is_nested(text: Column, typed: Column) -> Column:
    """The type is looked up only where the text may be that of an object or a list."""
    return F.substring(text, 1, 1).isin("{", "[") & F.substring(
        F.schema_of_variant(typed), 1, 5).isin("OBJEC", "ARRAY")


def entries(text: Column, typed: Column) -> Column:
    """Members of an object, or items of a list (without key), in written order.

    ``text`` keeps the order in which keys are written; ``typed`` tells objects from
    strings that look like one.
    """
    members = F.struct(F.from_json(text, "map<string,string>").alias("texts"),
                       typed.try_cast("map<string,variant>").alias("types"))
    items = F.arrays_zip(F.from_json(text, "array<string>").alias("text"),
                         typed.try_cast("array<variant>").alias("typed"))
    from_object = let(members, lambda m: F.transform(F.map_keys(m["texts"]), lambda key: F.struct(
        key.alias("key"), F.element_at(m["texts"], key).alias("text"),
        F.element_at(m["types"], key).alias("typed"))))
    from_list = F.transform(items, lambda p: F.struct(
        F.lit(None).cast("string").alias("key"), p["text"].alias("text"), p["typed"].alias("typed")))
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), from_object).otherwise(from_list)


def _outline(text: Column, typed: Column, pad: Column, depth: int) -> Column:
    shown = F.concat(pad, F.lit("- "), F.coalesce(text, F.lit("null")))
    if depth <= 0:
        return shown

    def line(node: Column, e: Column) -> Column:
        head = F.concat(node["pad"], F.lit("- **"), e["key"], F.lit("**: "))
        below = F.when(e["key"].isNull(), node["pad"]).otherwise(F.concat(node["pad"], F.lit("  ")))
        return F.when(is_nested(e["text"], e["typed"]), F.concat(
            F.coalesce(F.concat(head, F.lit("\n")), F.lit("")),
            _outline(e["text"], e["typed"], below, depth - 1),
        )).otherwise(F.concat(
            F.coalesce(head, F.concat(node["pad"], F.lit("- "))), F.coalesce(e["text"], F.lit("null"))))

    node = F.struct(text.alias("text"), typed.alias("typed"), pad.alias("pad"))
    return let(node, lambda n: F.when(is_nested(F.ltrim(n["text"]), n["typed"]), F.array_join(F.transform(
        entries(n["text"], n["typed"]), lambda e: line(n, e)), "\n")
    ).otherwise(F.concat(n["pad"], F.lit("- "), F.coalesce(n["text"], F.lit("null")))))
