import pytest
from pyspark.sql import functions as F

from helpers import day, table, tag
from tagloom.catalog import views
from tagloom.operators import links, search, stats, tables

SF = "/root/testdata/sf0.01"


def test_words():
    assert search.search_words('One "Two Three" four') == ["one", "two three", "four"]
    assert search.search_words("") == []


def ids(df):
    return [r["tid"] for r in df.collect()]


@pytest.fixture(scope="module")
def tags(spark):
    return table(
        spark,
        tag(1, "a", "Spark SQL engine", sts=["db", "x"]), tag(2, "b", "streaming with spark", sts=["db"]),
        tag(3, "c", "sql spark", sts=None), tag(4, "d", "nothing", sts=["db", "x", "spark"]),
        tag(5, "e", "Engine of Spark", sts=[]))


def test_search(tags):
    assert ids(search.search_and_tags(tags, "spark")) == [5, 3, 2, 1]
    assert ids(search.search_and_tags(tags, '"spark sql"')) == [1]
    assert ids(search.search_and_tags(tags, "SQL spark", ["db"])) == [1]
    assert ids(search.search_and_tags(tags, "", ["db", "x"])) == [4, 1]
    assert ids(search.search_and_tags(tags, "spark", n=2)) == [5, 3]
    assert sorted(ids(search.search_terms(tags, "spark", match_tags=True))) == [1, 2, 3, 4, 5]
    many = search.search_many(tags, {"p": "engine", "q": "sql"}).select("query", "tid").collect()
    assert sorted(map(tuple, many)) == [("p", 1), ("p", 5), ("q", 1), ("q", 3)]


def test_expected_counts(spark):
    docs = views.tags_documents(spark, SF)
    assert search.filter_all_tags(docs, ["en", "src1"]).count() == 37
    assert search.search_terms(search.filter_all_tags(docs, ["en"]), "the whou").count() == 196
    assert stats.duplicate_report(views.tags_dups(spark, SF)).count() == 80
    assert views.tags_events(spark, SF).select("dt").distinct().count() == 30


def test_filter_reaches_the_scan(spark):
    plan = search.get_by_ref_type(spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("tid"), F.col("source").alias("ref"), F.col("lang").alias("type")), "src1", "en")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in shown and "EqualTo(lang,en)" in shown
    assert "text" not in shown


def test_upsert_patch_delete(spark):
    old = table(spark, tag(1, "a"), tag(2, "b"), tag(None, "n"), tag(3, "c"))
    new = table(spark, tag(2, "B"), tag(9, "z"), tag(None, "m"))
    got = sorted((r["tid"] or 0, r["ref"]) for r in tables.upsert(old, new).collect())
    assert got == [(0, "m"), (0, "n"), (1, "a"), (2, "B"), (3, "c"), (9, "z")]
    changes = spark.createDataFrame([(1, "patched"), (3, None), (7, "lost")], "tid bigint, txt string")
    got = sorted((r["tid"] or 0, r["txt"]) for r in tables.bulk_update(old, changes).collect())
    assert got == [(0, "X"), (1, "patched"), (2, "X"), (3, "X")]
    got = tables.delete_by_key(old, spark.createDataFrame([(1,), (None,)], "tid bigint")).collect()
    assert sorted(r["ref"] for r in got) == ["b", "c", "n"]


def test_audit_and_missing_time(spark):
    old = spark.createDataFrame([("a", "1", day(0), day(0)), ("b", "1", day(0), day(0))],
                                "key string, value string, addAt timestamp, modAt timestamp")
    new = spark.createDataFrame([("b", None), ("c", "2")], "key string, value string")
    got = {r["key"]: tuple(r)[1:] for r in tables.audit_columns(old, new, day(5)).collect()}
    assert got == {"a": ("1", day(0), day(0)), "b": (None, day(0), day(5)), "c": ("2", day(5), day(5))}
    filled = tables.fill_missing_dt(table(spark, tag(1, "a", dt=None), tag(2, "b")), day(7)).collect()
    assert {r["tid"]: (r["dt"], r["fixed"]) for r in filled} == {1: (day(7), True), 2: (day(0), False)}


def test_insert_if_absent(spark):
    stored = tables.tag_rows(spark.createDataFrame([("x",)], "name string"), day(0)).unionByName(
        table(spark, tag(1, "y", type="tab")))
    names = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "name string")
    got = tables.insert_if_absent(stored, tables.tag_rows(names, day(1))).collect()
    assert sorted((r["ref"], r["txt"], r["sts"]) for r in got) == [("y", "y: ", ["y"]), ("z", "z: ", ["z"])]


def test_last_per_prefix_and_overlay(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "tid int, mdl string, v int")
    assert {r["tid"]: r["v"] for r in tables.last_per_prefix(df, ["tid"], ["mdl"]).collect()} == {1: 2, 2: 3}
    wanted = spark.createDataFrame([(2,), (2,), (5,)], "tid int")
    assert [r["v"] for r in tables.last_per_prefix(df, ["tid"], ["mdl"], wanted).collect()] == [3]
    defaults = spark.createDataFrame([("k", "d"), ("m", "d")], "key string, value string")
    stored = spark.createDataFrame([("k", "s"), ("other", "s")], "key string, value string")
    assert dict(search.tree_overlay(defaults, stored).collect()) == {"k": "s", "m": "d"}


def test_reassigned_keys_do_not_collide(spark):
    rows = table(spark, *[tag(None, f"r{i:03}") for i in range(200)])
    got = tables.reassign_pk(rows, ["type", "ref"], 1000, parts=5).collect()
    assert {r["ref"]: r["tid"] for r in got} == {f"r{i:03}": 1001 + i for i in range(200)}


def test_update_stats(spark):
    rows = table(spark, *[tag(i, f"r{i}", dt=day(i % 13), sts=["t", "dev_1"]) for i in range(26)],
                 tag(99, "lone", "only one", dt=day(20), sts=["p", "q"]), tag(100, "nodt", dt=None))
    got = stats.update_stats(rows, day(21)).orderBy(F.desc("dt")).collect()
    assert len(got) == 11
    assert (got[0]["n"], got[0]["max_tid"], got[0]["detail"]) == (1, 99, "test: only one #p, #q")
    assert (got[1]["n"], got[1]["detail"], got[1]["days_since_newest"]) == (2, None, 1.0)


def test_top_tags_in_a_hot_group(spark):
    rows = table(spark, *[tag(i, "r", sts=[f"t{i % 7}", "dev_9"]) for i in range(70)],
                 *[tag(i, "r", sts=["t3", "t5"]) for i in range(5)])
    got = stats.top_tags(rows).orderBy("rank").collect()
    assert [(r["tag"], r["n"]) for r in got] == [("t3", 15), ("t5", 15), ("t0", 10)]
    assert [tuple(r)[1:] for r in stats.dev_tag_counts(rows).collect()] == [("9", 70)]


def test_links_of_a_pasted_list(spark):
    docs = spark.createDataFrame([(
        "Reading:\n[Ferry times - Harbour](http://a.example)\n 2. [Book #novel](http://b.example/x)\nnot a link\n",)],
        "text string")
    got = links.ingest_md_links(docs, "text", day(0)).orderBy("ref").collect()
    assert [(r["txt"], r["ref"], r["sts"], r["type"]) for r in got] == [
        ("Ferry times", "http://a.example", ["markdown_pasted", "suffix_Harbour"], "tab"),
        ("Book", "http://b.example/x", ["markdown_pasted", "#novel"], "tab")]
