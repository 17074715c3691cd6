"""Merging of texts, tag lists and records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import stretches
from .core import array_or_empty, let


def merge3_text(before: Column, mine: Column, theirs: Column) -> Column:
    """Three-way merge of texts: my edits of ``before`` applied to ``theirs``.

    Each side may have edited several stretches. Edits that touch different places are
    kept; two insertions at one place keep mine first. Where edits of one place differ,
    ``theirs`` stands there, as with a patch that finds no place. Only rows that both sides
    edited leave the JVM. Not for use inside a lambda.
    """
    conflict = (before != mine) & (mine != theirs) & (before != theirs)
    patch = F.pandas_udf(stretches.merge_columns, "string")
    easy = (F.when(before.isNull() | mine.isNull() | theirs.isNull(), theirs)
            .when((before == mine) | (mine == theirs), theirs).when(before == theirs, mine))
    return easy.otherwise(patch(*(F.when(conflict, x) for x in (before, mine, theirs))))


def merge3_tags(before: Column, mine: Column, theirs: Column) -> Column:
    """Three-way merge of tag lists: what I took out goes, what I added comes in.

    A tag I replaced keeps its place in ``theirs``; further additions go last.
    """
    def apply(lists: Column) -> Column:
        gone, new, base = lists["gone"], lists["new"], lists["base"]
        kept = F.filter(F.transform(base, lambda t: F.when(
            F.array_position(gone, t) == 0, t
        ).otherwise(F.get(new, (F.array_position(gone, t) - 1).cast("int")))),
            lambda t: t.isNotNull())
        return F.array_union(kept, new)

    b, m, t = array_or_empty(before), array_or_empty(mine), array_or_empty(theirs)
    return let(F.struct(
        F.array_except(b, m).alias("gone"), F.array_except(m, b).alias("new"), t.alias("base"),
    ), apply)


def rec_merge(target: Column, source: Column, depth: int = 3) -> Column:
    """Merge two JSON texts: objects recurse, arrays are joined, otherwise source wins.

    At depth 0 the source is laid over the target without recursion; two arrays are
    then laid over each other place by place and become an object of places. A null
    that the source states wins like any other value. A missing text counts as {}, and
    so does one that is not JSON; of two that are not, the target stays as it is written.
    """
    empty = F.parse_json(F.lit("{}"))
    sides = F.struct(F.try_parse_json(target).alias("l"), F.try_parse_json(source).alias("r"))
    return let(sides, lambda s: F.when(
        s["l"].isNull() & s["r"].isNull() & target.isNotNull(), target,
    ).otherwise(let(F.coalesce(s["l"], empty), lambda l: let(
        F.coalesce(s["r"], empty), lambda r: F.to_json(_merge(l, r, depth))))))


def _kind(value: Column) -> Column:
    return F.substring(F.schema_of_variant(value), 1, 5)


def _as_map(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _as_list(value: Column) -> Column:
    return value.try_cast("array<variant>")


def _by_place(values: Column) -> Column:
    """An array as a map from its places, written as text."""
    return F.map_from_entries(F.transform(
        values, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))))


def _merge(left: Column, right: Column, depth: int) -> Column:
    kinds = F.concat(_kind(left), _kind(right))
    return let(kinds, lambda k: _merge_as(k == "OBJECOBJEC", k == "ARRAYARRAY", left, right, depth))


def _merge_as(both_objects: Column, both_lists: Column, left: Column, right: Column,
              depth: int) -> Column:

    def overlay(a: Column, b: Column) -> Column:
        return F.to_variant_object(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)))

    if depth <= 0:
        return (F.when(both_objects, overlay(_as_map(left), _as_map(right)))
                .when(both_lists, overlay(_by_place(_as_list(left)), _by_place(_as_list(right))))
                .otherwise(right))
    deep = F.to_variant_object(F.map_zip_with(
        _as_map(left), _as_map(right),
        lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(_merge(x, y, depth - 1))))
    joined = F.to_variant_object(F.concat(_as_list(left), _as_list(right)))
    return F.when(both_objects, deep).when(both_lists, joined).otherwise(right)
