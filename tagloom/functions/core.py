"""Small building blocks shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters a browser counts as white space.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only ASCII blanks."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def first_index(text: Column, needle: str, start: Column) -> Column:
    """Zero-based first position of ``needle`` at or after ``start``, else null."""
    at = F.position(F.lit(needle), text, start.cast("int") + 1)
    return F.when(at > 0, at - 1)


def last_index(text: Column, needle: str) -> Column:
    """Zero-based last position of ``needle``, else -1."""
    at = F.position(F.lit(needle[::-1]), F.reverse(text))
    return F.when(at > 0, F.length(text) - at - (len(needle) - 1)).otherwise(-1)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters from zero-based ``start`` up to but not including ``end``."""
    return F.substring(text, start.cast("int") + 1, F.greatest(F.lit(0), end - start).cast("int"))


def array_or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def running_starts(lengths: Column, step: int = 256) -> Column:
    """Offset at which each element begins when the elements are laid end to end.

    Works in two levels (blocks, then places within a block), so a text of many
    thousand lines costs about ``n * step / 2`` additions instead of ``n * n / 2``.
    """
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def starts(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), ((F.size(xs) - 1) / step).cast("int")),
            lambda b: total(F.slice(xs, b * step + 1, F.lit(step))),
        )
        block_starts = let(blocks, lambda bs: F.transform(
            bs, lambda _, i: total(F.slice(bs, F.lit(1), i))))
        return let(block_starts, lambda bs: F.transform(xs, lambda _, i: (
            F.get(bs, (i / step).cast("int"))
            + total(F.slice(xs, (i / step).cast("int") * step + 1, i % step)))))

    typed = F.transform(lengths, lambda n: n.cast("bigint"))
    return let(typed, lambda xs: F.when(F.size(xs) > 0, starts(xs)).otherwise(
        F.array().cast("array<bigint>")))


def common_prefix(a: Column, b: Column, bits: int = 30) -> Column:
    """Length of the common prefix, found by halving.

    Each step compares the first halves and goes on with the halves that still matter,
    so the texts get shorter and the whole costs a few passes over them.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(bits, -1, -1)])

    def state(got: Column, x: Column, y: Column, top: Column) -> Column:
        return F.struct(got.alias("got"), x.alias("x"), y.alias("y"), top.alias("top"))

    def halve(s: Column, step: Column) -> Column:
        heads = F.struct(F.substring(s["x"], F.lit(1), step).alias("x"),
                         F.substring(s["y"], F.lit(1), step).alias("y"))
        rest = s["top"] - step
        return F.when(step > s["top"], s).otherwise(let(heads, lambda h: F.when(
            h["x"] == h["y"],
            state(s["got"] + step, F.substring(s["x"], step + 1, rest), F.substring(s["y"], step + 1, rest), rest),
        ).otherwise(state(s["got"], h["x"], h["y"], step - 1))))

    def fold(p: Column) -> Column:
        start = state(F.lit(0), p["a"], p["b"], F.least(F.length(p["a"]), F.length(p["b"])))
        return F.aggregate(steps, start, halve, lambda s: s["got"])

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: (
        F.when(F.startswith(p["b"], p["a"]), F.length(p["a"]))
        .when(F.startswith(p["a"], p["b"]), F.length(p["b"])).otherwise(fold(p))))


def common_suffix(a: Column, b: Column, bits: int = 30) -> Column:
    """Length of the common suffix."""
    return F.when(F.endswith(b, a), F.length(a)).otherwise(
        common_prefix(F.reverse(a), F.reverse(b), bits))
