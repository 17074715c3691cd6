"""Writes by key: of several rows with one key the last one counts."""

from tagloom.operators import tables


def test_upsert_puts_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "tid long, txt string, at int")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "c", 5), (3, "d", 9), (None, "m", 1), (None, "m", 1)], "tid long, txt string, at int")
    got = sorted(map(tuple, tables.upsert(old, new, order=["at"]).select("tid", "txt").collect()), key=str)
    assert got == sorted([(1, "x"), (2, "b"), (3, "d"), (None, "n"), (None, "m"), (None, "m")], key=str)


def test_bulk_update_multiplies_no_row(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "tid long, txt string, type string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1), (None, "w", 1)], "tid long, txt string, at int")
    got = sorted(map(tuple, tables.bulk_update(old, changes, order=["at"]).collect()))
    assert got == [(1, "y", "k"), (2, "b", "k")]
