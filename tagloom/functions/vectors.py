"""Vector functions on array columns, in double precision."""

from pyspark.sql import Column, functions as F

# Fixed value: norm used in place of zero.
NORM_FLOOR = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, length).otherwise(F.lit(NORM_FLOOR))


def cosine(a: Column, b: Column) -> Column:
    denominator = norm(a) * norm(b)
    return F.when(denominator > 0, dot(a, b) / denominator).otherwise(F.lit(0.0))
