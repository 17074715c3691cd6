import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.functions import core, dates, merge, records, stretches, tags, text, vectors

L = F.lit


def strings(*items):
    return F.array(*[L(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize("title, cleaned, found", [
    ("Ferry - Web Search", "Ferry", ["suffix_WebSearch"]),
    ("Motor works #biology #science - Video", "Motor works", ["#biology", "#science", "suffix_Video"]),
    ("Reading list | rates & more | Stream", "Reading list | rates & more", ["suffix_Stream"]),
    ("練習帳（詳細解答） 鸡娃客", "練習帳（詳細解答）", ["suffix_鸡娃客"]),
    ("no site here", "no site here", []),
    ("a title of well over thirty three characters. The rest goes",
     "a title of well over thirty three characters", []),
    ("keeps `x. y` as code and goes on for long `after. it. ends` here. Cut",
     "keeps `x. y` as code and goes on for long `after", []),
])
def test_clean_title(value, title, cleaned, found):
    got = value(text.clean_title(L(title)))
    assert (got["txt"], got["sts"]) == (cleaned, found)


def test_clean_title_trims_wide_blanks(value):
    assert value(text.clean_title(L("wide　text　 - Site")))["txt"] == "wide　text"


def test_title_with_tags(value):
    got = value(text.title_with_tags(L("on #Spark today"), strings("spark", "new tag!", "sql")))
    assert got == "on #Spark today  newtag sql"


def test_split_tag_text(value):
    got = value(text.split_tag_text(L("one #two  three #four")))
    assert (got["txt"], got["sts"]) == ("#two #four", ["one", "three"])


@pytest.mark.parametrize("url, domain", [
    ("https://www.news.example.com/a?b=1", "news.example.com"),
    ("http://example.org", "example.org"),
    ("example.co.uk", "example.co.uk"),
    ("file:///C:/Users/me/page.html", "/C:/Users"),
    ("file://srv-01.example.com/vol/doc.pdf", "srv-01.example.com"),
])
def test_url_domain(value, url, domain):
    assert value(text.url_domain(L(url))) == domain


def test_link_line(value):
    got = value(text.link_line(L("  2. [A title](http://x.example/p\\](q)")))
    assert (got["title"], got["ref"]) == ("A title", "http://x.example/p](q")
    assert value(text.link_line(L("plain text (no link)"))) is None


def test_extract_links_orders_and_removes_copies(value):
    html = '<p>see <a class="k" href="/b">b</a> <a href="/a">a</a> http://p.example/x y <a href="/b">b</a>'
    assert value(text.extract_links(L(html))) == ["/b", "/a", "http://p.example/x"]


@pytest.mark.parametrize("link, absolute", [
    ("http://other.example/x", "http://other.example/x"), ("mailto:a@b.example", "mailto:a@b.example"),
    ("//cdn.example/x", "https://cdn.example/x"), ("/top", "https://a.example/top"),
    ("next.html", "https://a.example/dir/next.html"), ("#part", "https://a.example/dir/page?q=1#part"),
    ("?p=2", "https://a.example/dir/page?p=2"),
])
def test_absolute_link(value, link, absolute):
    assert value(text.absolute_link(L(link), L("https://a.example/dir/page?q=1#top"))) == absolute
    assert value(text.absolute_link(L("x"), L("https://a.example"))) == "https://a.example/x"


def test_feed_first_post(value):
    feed = {"data": {"cards": [{"card_type": 11}, {"card_type": 9, "mblog": {"text": " <b>first</b> "}},
                               {"card_type": 9, "mblog": {"text": "second"}}]}}
    assert value(text.feed_first_post(L(json.dumps(feed)))) == "first"
    assert value(text.feed_first_post(L("{}"))) == "(no post found)"


def test_highlight_tags(value):
    got = value(text.highlight_tags(L("Spark SQL and c++"), strings("sql", "c++", "spark", "java")))
    assert got["matched"] == ["spark", "sql", "c++"]
    assert got["unmatched"] == ["java"]
    empty = value(text.highlight_tags(L("x"), strings()))
    assert (empty["matched"], empty["unmatched"]) == ([], [])


def test_escape_and_strip(value):
    assert value(text.escape_xml(L("<a b=\"c\">'&amp;"))) == "&lt;a b=&quot;c&quot;&gt;&apos;&amp;amp;"
    assert value(text.strip_html(L(" <p>x <b>y</b></p>　"))) == "x y"


def test_tag_lists(value):
    assert value(tags.plain_tags(strings("a", "dev_x", "b"))) == ["a", "b"]
    assert value(tags.device_tags(strings("a", "dev_x", "b"))) == ["x"]
    assert value(tags.tags_to_lines(L(None).cast("array<string>"))) == ""
    assert value(tags.lines_to_tags(L("a\n\nb"))) == ["a", "b"]
    assert value(tags.lines_to_tags(L("\n"))) is None
    assert value(tags.has_all_tags(strings("a", "b"), ["a", "b"])) is True
    assert value(tags.has_all_tags(L(None).cast("array<string>"), ["a"])) is False


def test_content_digest_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame(
        [("r", "t", "k", None), ("r", "t", "k", []), ("r", "t", "k", [""]), ("r", "t", "k", ["a,b"]),
         ("r", "t", "k", ["a", "b"]), ("r|t", "", "k", None), ("r", "|t", "k", None)],
        "ref string, txt string, type string, sts array<string>")
    assert df.select(tags.content_digest()).distinct().count() == 7


def test_dates(value):
    stamp = L(datetime(2024, 1, 5, 9, 30)).cast("timestamp")
    assert value(dates.fmt_mdwhm(stamp)) == "2024  1/05 Fri 09:30"
    assert value(dates.fmt_ym(stamp)) == "2024-01"
    assert value(dates.fmt_md(stamp)) == "1/05"
    assert value(dates.diff_days(stamp, stamp - F.expr("interval 36 hours"))) == 1.5


def test_cosine(value):
    def vec(*xs):
        return F.array(*[L(float(x)).cast("float") for x in xs])
    assert value(vectors.cosine(vec(1, 0), vec(1, 1))) == pytest.approx(0.5 ** 0.5)
    assert value(vectors.cosine(vec(0, 0), vec(1, 1))) == 0.0


@pytest.mark.parametrize("before, mine, theirs, merged", [
    ("hello", "hello there", "hello world", "hello there world"),
    ("hello", "hello", "hello world", "hello world"),
    ("hello", "hello there", "hello", "hello there"),
    ("one two three", "one 2 three", "one two three four", "one 2 three four"),
    ("one two three", "one two three!", "zero one two three", "zero one two three!"),
    ("abc", "aXc", "aYc", "aYc"),
    ("aaa", "aaaa", "aaa b", "aaaa b"),
    ("", "mine", "theirs", "minetheirs"),
    ("日本語", "日本語。", "新日本語", "新日本語。"),
    (None, "mine", "theirs", "theirs"),
    ("one two three four", "ONE two three FOUR", "one two 3 four", "ONE two 3 FOUR"),
    ("one two three four", "ONE two THREE four", "one 2 THREE 4", "ONE 2 THREE 4"),
    ("a b c d e f", "a B c d E f", "a b C d e F", "a B C d E F"),
    ("a b c d e f", "a X c d e F", "a Y c D e f", "a Y c D e F"),
    ("one two three four five", "two three five", "one two 3 four five!", "two 3 five!"),
    ("a\nb\nc\nd\n", "a\nB\nc\nd\nnew mine\n", "first\na\nb\nc\nD\n", "first\na\nB\nc\nD\nnew mine\n"),
])
def test_merge3_text(value, before, mine, theirs, merged):
    got = value(merge.merge3_text(L(before).cast("string"), L(mine), L(theirs)))
    assert got == merged


@pytest.mark.parametrize("before, mine, theirs, merged", [
    (["a", "b"], ["a", "c"], ["a", "b", "x"], ["a", "c", "x"]),
    (["x"], ["x", "y"], ["x", "z"], ["x", "z", "y"]),
    (["a", "b"], ["b"], ["a", "b", "c"], ["b", "c"]),
    (["a"], [], ["a"], []),
    (None, ["n"], None, ["n"]),
])
def test_merge3_tags(value, before, mine, theirs, merged):
    def arr(items):
        return L(None).cast("array<string>") if items is None else strings(*items)
    assert value(merge.merge3_tags(arr(before), arr(mine), arr(theirs))) == merged


@pytest.mark.parametrize("target, source, depth, merged", [
    ({"a": 1, "b": 1}, {"b": 2}, 3, {"a": 1, "b": 2}),
    ({"a": [1]}, {"a": [2]}, 3, {"a": [1, 2]}),
    ({"a": 1}, {"a": None}, 3, {"a": None}),
    ({"a": {"b": {"c": 1}}}, {"a": {"b": {"d": 2}}}, 3, {"a": {"b": {"c": 1, "d": 2}}}),
    ({"a": {"b": {"c": {"d": 1, "e": [1]}}}}, {"a": {"b": {"c": {"e": [2]}}}}, 3,
     {"a": {"b": {"c": {"d": 1, "e": [2]}}}}),
    ({"a": {"b": 1}}, {"a": {"c": 1}}, 0, {"a": {"c": 1}}),
    ({"a": {"b": {"c": [1, 2]}}}, {"a": {"b": {"c": [9]}}}, 3, {"a": {"b": {"c": {"0": 9, "1": 2}}}}),
    ({"a": "1"}, {"b": 1.5}, 3, {"a": "1", "b": 1.5}),
    (None, {"a": 1}, 3, {"a": 1}),
])
def test_rec_merge(value, target, source, depth, merged):
    got = value(merge.rec_merge(
        L(None if target is None else json.dumps(target)).cast("string"), L(json.dumps(source)), depth))
    assert json.loads(got) == merged


def test_outline(value):
    record = {"name": "x", "of": [{"b": 1, "a": "t"}, {"b": 2}], "deep": {"k": {"z": None}}, "s": [1, "two"], "j": "{}"}
    assert value(records.outline(L(json.dumps(record)))) == "\n".join([
        "- **name**: x", "- **of**: ", "  - **b**: 1", "  - **a**: t", "  - **b**: 2",
        "- **deep**: ", "  - **k**: ", "    - **z**: null", "- **s**: ", "  - 1", "  - two", "- **j**: {}"])


def test_running_starts(value):
    lengths = [(i * 7) % 11 for i in range(1000)]
    starts = value(core.running_starts(F.array(*[L(n) for n in lengths])))
    assert starts == [sum(lengths[:i]) for i in range(1000)]
    assert value(core.running_starts(F.array().cast("array<int>"))) == []


def test_line_kinds(spark):
    lines = {"# h": "heading", "- x": "listItem", "3. x": "listItem", "> q": "blockquote", "```py": "code",
             "<div>": "html", "[a](b)": "link", "text": "paragraph", "#tag": "paragraph"}
    df = spark.createDataFrame([(k,) for k in lines], "seg string")
    assert dict(df.select("seg", records.line_kind(F.col("seg"))).collect()) == lines


def test_stretches_of_random_edits():
    """Edits of different words are all kept, whichever side made them."""
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice([f"w{k}", f"é😀{k}"]) for k in range(rng.randint(1, 60))]
        mine, theirs, both = words[:], words[:], words[:]
        for k in range(0, len(words), 2):  # the words between two edits stay
            side = rng.randrange(4)
            if side < 2:
                new = rng.choice([f"new{k}", f"two new{k}"])
                (mine if side else theirs)[k] = new
                both[k] = new
        b, m, t = " ".join(words), " ".join(mine), " ".join(theirs)
        assert stretches.merge(b, m, b) == m and stretches.merge(b, b, t) == t
        assert stretches.merge(b, m, t).split() == " ".join(both).split()


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(5)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    for few, most in ((50_000, 2_000_000), (0, 2_000_000), (0, 20)):
        monkeypatch.setattr(stretches, "FEW_PAIRS", few)
        monkeypatch.setattr(stretches, "MOST_PAIRS", most)
        monkeypatch.setattr(stretches, "MOST_EDITS", 200 if most > 100 else 6)
        for _ in range(200):
            a, b = ([rng.choice("abcdefgh") + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randint(0, 30))] for _ in range(2))
            got = stretches.align(a, b)
            assert all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
            assert len(got) == longest(a, b) if most > 100 else len(got) <= longest(a, b)


def test_long_texts_merge_in_time():
    words = [f"w{(k * k) % 977}" for k in range(40_000)]
    mine, theirs = words[:], words[:]
    mine[5], mine[-5], theirs[20_000] = "MINE", "END", "THEIRS"
    merged = stretches.merge(" ".join(words), " ".join(mine), " ".join(theirs)).split()
    assert [merged[5], merged[-5], merged[20_000], len(merged)] == ["MINE", "END", "THEIRS", 40_000]
    same = "x " * 30_000
    assert stretches.merge(same, "a " + same + "b", same[:30_000] + "mid " + same[30_000:]).split().count("x") == 30_000


def test_links_in_the_forms_that_browsers_accept(value):
    html = """<a href=plain.html>1</a> <A class=x HREF = 'single.html?a=1&amp;b=2' >2</A> <a\nhref="two words.html">3</a>
              <a href=/x/y>4</a> <a data-href=no.html href="&#x2F;num&#47;&#233;">5</a> <a href="">6</a> <a name=x>7</a>
              <p>see https://a.b/c?d=1&amp;e=&#50;&lt; and &amp;#50; </p><a href="plain.html">again</a>"""
    got = value(text.extract_links(L(html)))
    assert got == ["plain.html", "single.html?a=1&b=2", "two words.html", "/x/y", "/num/é", "", "https://a.b/c?d=1&e=2<"]
    assert value(text.unescape_html(L("&amp;lt; &#128512;&#xD800;&#0; &nope; &#9999999;"))) == "&lt; 😀\ufffd\ufffd &nope; \ufffd"
    assert value(text.unescape_html(L(None).cast("string"))) is None
