"""Documents as ordered segments, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.records import entries, is_nested, line_segments, outline, segment_tags
from ..plans.ordered import running_sum
from ..plans.shared import through_table


def segment_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seq, start, seg, kind): the lines of each text, without gaps.

    An empty text is one empty segment; a null text one row without segment.
    """
    return (docs.select(doc_id, F.posexplode_outer(line_segments(F.col(text))).alias("seq", "s"))
            .select(doc_id, F.col("seq").cast("bigint").alias("seq"), "s.start", "s.seg", "s.kind"))


def segment_offsets(segments: DataFrame, doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Where each segment starts, for segments that come without their text's row.

    Only (doc_id, seq, length) is shuffled, and a document of very many segments is
    split between tasks.
    """
    lengths = segments.select(doc_id, "seq", F.length("seg").cast("bigint").alias("len"))
    return running_sum(lengths, [doc_id], ["seq"], "len", "start", parts)


def rebuild_documents(segments: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Texts put together from their segments, in order of their start; null where there is none."""
    parts = F.array_sort(F.collect_list(F.struct("start", "seg")))
    text = F.array_join(F.transform(parts, lambda p: p["seg"]), "")
    return segments.groupBy(doc_id).agg(F.when(F.count("seg") > 0, text).alias("text"))


def tag_segments(segments: DataFrame) -> DataFrame:
    """Each segment with its attributes as a list of tags."""
    return segments.withColumn("tags", segment_tags(
        F.col("kind"), F.col("seg"), F.col("seq"), F.col("start")))


# Brackets up to which a record's outline is one expression.
SHALLOW = 4


def outline_records(records: DataFrame, column: str = "record", depth: int | None = None) -> DataFrame:
    """Nested JSON records as indented bullet outlines, keys in the order they are written.

    A record with few brackets cannot nest deep and is one expression of fixed size. The
    others go down one level at a time, as deep as they really nest: a level is a table of
    lines with their places, and of what nests below them. ``depth`` shows deeper levels as
    JSON text. No expression grows with the depth.
    """
    if depth is None:
        brackets = F.length(column) - F.length(F.translate(column, "{[", ""))
        deep = F.coalesce(brackets > SHALLOW, F.lit(False))
        return records.where(~deep).withColumn("outline", outline(F.col(column), SHALLOW)).unionByName(
            _level_by_level(records.where(deep), column, None))
    return _level_by_level(records, column, depth)


def _level_by_level(records: DataFrame, column: str, depth: int | None) -> DataFrame:
    rows = through_table(records.withColumn("_row", F.monotonically_increasing_id()), "records")
    place = F.array().cast("array<int>")
    root = F.lit(depth != 0) & is_nested(F.ltrim(F.col(column)), F.try_parse_json(column))
    plain = F.concat(F.lit("- "), F.coalesce(F.col(column), F.lit("null")))
    top = rows.select("_row", place.alias("place"), F.coalesce(root, F.lit(False)).alias("nested"), F.col(column).alias("text"))
    lines = rows.where(~F.coalesce(root, F.lit(False))).select("_row", place.alias("place"), plain.alias("line"))
    todo, level = top.where("nested").select("_row", "place", F.lit("").alias("pad"), "text"), 0
    while True:
        level += 1
        found = through_table(_level_of(todo, depth is None or level < depth), "outline")
        lines = lines.unionByName(found.where("line IS NOT NULL").select("_row", "place", "line"))
        todo = found.where("text IS NOT NULL").select("_row", "place", "pad", "text")
        if todo.isEmpty():
            break
    whole = lines.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("outline"))
    return rows.join(whole, "_row").drop("_row")


def _level_of(nodes: DataFrame, deeper: bool) -> DataFrame:
    """The members of nested nodes: a line each, and for those that nest their text and indent.

    A node without members is an empty line; a list in a list has no line of its own.
    """
    members = nodes.select("_row", "place", "pad", F.posexplode_outer(
        entries(F.col("text"), F.try_parse_json("text"))).alias("at", "e"))
    nested = F.coalesce(F.lit(deeper) & is_nested(F.col("e.text"), F.col("e.typed")), F.lit(False))
    head = F.concat("pad", F.lit("- **"), "e.key", F.lit("**: "))
    text = F.coalesce("e.text", F.lit("null"))
    line = (F.when(F.col("at").isNull(), F.lit("")).when(nested, head)
            .otherwise(F.concat(F.coalesce(head, F.concat("pad", F.lit("- "))), text)))
    return members.select(
        "_row", F.concat("place", F.array(F.coalesce("at", F.lit(0)))).alias("place"), line.alias("line"),
        F.when(F.col("e.key").isNull(), F.col("pad")).otherwise(F.concat("pad", F.lit("  "))).alias("pad"),
        F.when(nested, text).alias("text"))
