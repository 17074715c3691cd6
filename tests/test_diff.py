from pyspark.sql import functions as F

from helpers import table, tag
from tagloom.catalog import views
from tagloom.operators import diff

SF = "/root/testdata/sf0.01"


def test_expected_counts(spark):
    """The two devices each lack a tenth of the rows, and a tenth was edited."""
    docs = views.tags_documents(spark, SF)
    rest = F.col("tid") % 10
    server = docs.where(rest != 9)
    local = docs.where(rest != 8).withColumn(
        "txt", F.when(rest == 5, F.concat("txt", F.lit(" edited"))).otherwise(F.col("txt")))
    got = diff.diff_summary(diff.diff_tags(local, server)).first()
    assert (got["matched"], got["clash"], got["new"], got["matched_pct"]) == (700, 100, 100, 77.8)
    assert diff.diff_new(local, server).count() == 200
    assert diff.diff_clash(local, server).count() == 100


def test_same_tables_match(spark):
    docs = views.tags_documents(spark, SF)
    got = diff.diff_summary(diff.diff_tags(docs, docs)).first()
    assert (got["matched"], got["total"], got["matched_pct"]) == (1000, 1000, 100.0)


def test_empty_local_and_copies(spark):
    incoming = table(spark, *[tag(1, "a") for _ in range(5)], tag(2, "b", sts=[]), tag(None, "c"))
    assert diff.diff_tags(table(spark), incoming).where("status = 'new'").count() == 7
    local = table(spark, *[tag(i, "a") for i in range(1, 30)], tag(2, "b", sts=None))
    got = sorted((r["ref"], r["status"]) for r in diff.diff_tags(local, incoming).collect())
    assert got == [("a", "matched")] * 5 + [("b", "clash"), ("c", "new")]
    assert diff.diff_summary(diff.diff_tags(local, table(spark))).first()["matched_pct"] is None
