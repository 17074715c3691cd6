"""Keys, tag lists and other functions of single rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import array_or_empty

# Fixed value: prefix of tags that name a device.
DEVICE_PREFIX = "dev_"


def uniq_key(type_: Column | str = "type", ref: Column | str = "ref") -> Column:
    """Logical identity of a row: the pair, so that no two pairs run together."""
    return F.struct(_col(type_).alias("type"), _col(ref).alias("ref"))


def content_digest(ref="ref", txt="txt", type_="type", sts="sts") -> Column:
    """SHA-256 of the content key. Null, empty and missing tags stay apart.

    Joining on 32 bytes instead of the row's whole text keeps the text out of the
    exchange on the side that only answers "is it there?".
    """
    packed = F.to_json(F.struct(
        _col(ref).alias("a"), _col(txt).alias("b"), _col(type_).alias("c"), _col(sts).alias("d"),
    ), {"ignoreNullFields": "false"})
    # Never null, so that no join has to test the digest, and compute it again, for that.
    return F.coalesce(F.unhex(F.sha2(packed, 256)), F.lit(b""))


def row_equal(left: str, right: str) -> Column:
    """Same ref, text and type; nulls are equal to nulls."""
    same = F.lit(True)
    for name in ("ref", "txt", "type"):
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def plain_tags(sts: Column) -> Column:
    return F.filter(sts, lambda t: ~F.startswith(t, F.lit(DEVICE_PREFIX)))


def device_tags(sts: Column) -> Column:
    """Device tags without their prefix."""
    own = F.filter(sts, lambda t: F.startswith(t, F.lit(DEVICE_PREFIX)))
    return F.transform(own, lambda t: F.substring(t, F.lit(len(DEVICE_PREFIX) + 1), F.length(t)))


def has_all_tags(sts: Column, wanted: list[str]) -> Column:
    """True when the list contains every wanted tag; null lists contain none."""
    keep = F.lit(True)
    for tag in wanted:
        keep = keep & F.coalesce(F.array_contains(sts, tag), F.lit(False))
    return keep


def tags_to_lines(sts: Column) -> Column:
    return F.array_join(array_or_empty(sts), "\n")


def lines_to_tags(text: Column) -> Column:
    """Non-empty lines; null when there is none."""
    lines = F.filter(F.split(text, "\n"), lambda t: t != "")
    return F.when(F.size(lines) > 0, lines)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
