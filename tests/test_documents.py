import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.operators import documents

TEXT = st.text(alphabet=st.sampled_from(list("ab#-> `\n\r\té語😀")), max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXT, min_size=1, max_size=25))
def test_rebuild_gives_the_text_back(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    segments = documents.segment_documents(docs).collect()
    rebuilt = {}
    for s in sorted(segments, key=lambda r: (r["doc_id"], r["start"])):
        assert s["start"] == len(rebuilt.get(s["doc_id"], ""))
        rebuilt[s["doc_id"]] = rebuilt.get(s["doc_id"], "") + s["seg"]
    assert rebuilt == dict(enumerate(texts))
    again = documents.rebuild_documents(documents.segment_documents(docs)).collect()
    assert {r["doc_id"]: r["text"] for r in again} == rebuilt


def test_empty_and_null_texts_stay(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a\n")], "doc_id int, text string")
    segments = documents.segment_documents(docs)
    assert sorted((r["doc_id"], r["seq"] if r["seq"] is not None else -1, r["seg"]) for r in segments.collect()) == [
        (1, 0, ""), (2, -1, None), (3, 0, "a\n")]
    again = {r["doc_id"]: r["text"] for r in documents.rebuild_documents(segments).collect()}
    assert again == {1: "", 2: None, 3: "a\n"}


def test_segmenting_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "# a\nb")], "doc_id int, text string")
    plan = documents.segment_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_document(spark):
    text = "".join(f"line {i}\n" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = documents.segment_documents(docs).agg(F.count("*"), F.max("start")).first()
    assert tuple(got) == (3000, len(text) - len("line 2999\n"))
    offsets = documents.segment_offsets(documents.segment_documents(docs).select("doc_id", "seq", "seg"))
    assert offsets.agg(F.max("start")).first()[0] == got[1]


def test_tags(spark):
    docs = spark.createDataFrame([(1, "## T\n[a](http://u)\n```py\n\n")], "doc_id int, text string")
    got = [r["tags"] for r in documents.tag_segments(documents.segment_documents(docs)).orderBy("seq").collect()]
    assert got == [
        ["#heading;heading_1", "#ref=heading", "#seq=0", "#parent=root", "#val=T", "#meta=level:2"],
        ["#link;link_2", "#ref=link", "#seq=5", "#parent=root", "#val=[a](http://u)", "#meta=url:http://u"],
        ["#code;code_3", "#ref=code", "#seq=19", "#parent=root", "#val=```py", "#meta=lang:py"],
        ["#paragraph;paragraph_4", "#ref=paragraph", "#seq=25", "#parent=root"]]


def plain_outline(value, pad=""):
    if not isinstance(value, (dict, list)):
        return [pad + "- " + shown(value)]
    out = []
    for key, item in value.items() if isinstance(value, dict) else ((None, x) for x in value):
        if isinstance(item, (dict, list)):
            out += [] if key is None else [f"{pad}- **{key}**: "]
            out += plain_outline(item, pad if key is None else pad + "  ")
        else:
            out.append(f"{pad}- **{key}**: {shown(item)}" if key is not None else f"{pad}- {shown(item)}")
    return out or [""]


def shown(value):
    return value if isinstance(value, str) else json.dumps(value)


def test_outlines_of_any_depth(spark):
    deep = "leaf"
    for k in range(9):
        deep = {f"k{k}": deep, "n": k} if k % 3 else [deep, k, "x"]
    records = [
        {"name": "x", "of": [{"b": 1, "a": "t"}, {"b": 2}], "deep": {"k": {"z": None}}, "s": [1, "two"], "j": "{}"},
        {"a": {"b": {"c": {"d": {"e": {"f": "six"}}}}}}, deep, {}, [], {"e": {}, "l": []}, [[1, [2, [3]]], {"z": [[4]]}], [{"x": 1}] * 3]
    rows = [(k % 5, json.dumps(r)) for k, r in enumerate(records)] + [(0, None), (1, "not json"), (2, json.dumps(records[1])), (3, "7")]
    df = spark.createDataFrame(rows, "id int, record string").repartition(3)
    got = documents.outline_records(df)
    assert got.columns == ["id", "record", "outline"]
    def want(text):
        try:
            return "\n".join(plain_outline(json.loads(text)))
        except (TypeError, ValueError):
            return f"- {text}" if text is not None else "- null"
    assert sorted((r["id"], str(r["record"]), r["outline"]) for r in got.collect()) == sorted((i, str(t), want(t)) for i, t in rows)
    limited = {r["record"]: r["outline"] for r in documents.outline_records(df, depth=2).collect()}
    assert limited[json.dumps(records[1])] == '- **a**: \n  - **b**: {"c":{"d":{"e":{"f":"six"}}}}'
    assert documents.outline_records(df.limit(0)).count() == 0
