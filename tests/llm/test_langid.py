import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import catalog, langid

from .plain import DATA, hard

LARGER = "/root/testdata/sf0.01"


def grams(word):
    marked = f"<{word}>"
    return [marked[k:k + n] for n in range(langid.SHORTEST, langid.LONGEST + 1) for k in range(len(marked) - n + 1)]


def words(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def plain_sets(rows):
    """Language -> n-grams that enough of its documents have."""
    counts, many = {}, Counter()
    for _, text, lang in rows:
        many[lang] += 1
        counts.setdefault(lang, Counter()).update({g for w in words(text or "") for g in grams(w)})
    return {lang: {g for g, n in c.items() if n >= max(langid.LEAST, langid.SHARE * many[lang])} for lang, c in counts.items()}


def plain_shares(sets, text):
    found = [g for w in words(text) for g in grams(w)]
    return {lang: sum(g in own for g in found) / len(found) for lang, own in sets.items()} if found else {}


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    return langid.learn(docs.where(~(langid.fold_of(5) == 0))), plain_sets(known), rows


def test_filters_hold_all_that_the_languages_have(learned):
    filters, sets, rows = learned
    assert filters.languages == sorted(sets)
    known = sorted({w for _, text, _ in rows for w in words(text or "")})
    marked = [f"<{w}>" for w in known]
    told = [m[k:k + n] for n in range(langid.SHORTEST, langid.LONGEST + 1) for m in marked for k in range(len(m) - n + 1)]
    code = dict(zip(told, langid.grams_of(known)[1], strict=True))
    for k, lang in enumerate(filters.languages):
        assert filters.languages_of(np.array([code[g] for g in sorted(sets[lang])]))[:, k].all()
    foreign = filters.languages_of(np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64))
    assert np.abs(foreign.mean(0) - filters.false).max() < 0.005


def test_judge_against_exact_sets(learned):
    filters, sets, rows = learned
    texts = [t or "" for _, t, _ in rows]
    found, scores = langid.Judge(filters).judge(texts)
    same = off = 0
    for text, lang, score in zip(texts, found, scores):
        shares = plain_shares(sets, text)
        if not shares:
            assert (lang, score) == ("und", 0)
            continue
        best = max(shares, key=lambda x: (shares[x], [-ord(c) for c in x]))
        same += lang == best
        off = max(off, abs(score - shares[lang] / max(sum(shares.values()), 1e-9)))
    assert same >= 0.995 * len(texts) and off < 0.05


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = catalog.QUERIES["op12_language_id"](spark, LARGER).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_small_sample_of_each_language_is_enough(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = langid.predict(docs, per_language=60).join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_hard_rows_none_and_unlabelled(spark):
    docs = hard(spark)
    rows = langid.predict(docs.drop("lang").selectExpr("*", "CASE WHEN doc_id > 3 THEN 'xx' END AS lang")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["lang_pred"] == ("und" if r["doc_id"] in (1, 2, 3) else "xx")
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    none = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(none).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0)).count() == 0


def test_more_languages_than_bits_in_a_byte(spark):
    rows = [(100 * k + j, " ".join(f"{chr(97 + k)}{chr(0x430 + j % 5)}{chr(98 + k)}" for _ in range(30)), f"l{k:02}")
            for k in range(20) for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {i: lang for i, _, lang in rows}
    got = langid.predict(docs).collect()
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got) and len(got) == len(rows)


def test_texts_without_letters_or_known_grams(spark):
    docs = spark.createDataFrame(
        [(k, "abc abd abe", "aa") for k in range(1, 30)] + [(k, "xyz xyw", "bb") for k in range(30, 60)]
        + [(100, "123 !? ́", None), (101, "ЖЖЖ", None), (102, None, "aa")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs).collect()}
    assert got[100] == ("und", 0) and got[102] == ("und", 0)
    assert got[101][0] in ("aa", "bb") and got[1][0] == "aa" and got[40][0] == "bb"
