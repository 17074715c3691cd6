"""Titles, hashtags, addresses and markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import SPACE, array_or_empty, first_index, last_index, let, slice_text, trim_space

# What separates a title from the site's name.
SITE_SEPARATORS = [" - ", " | ", "-", "|", " _", " · ", " — ", " – ", "/ X", " 鸡娃客", "_哔哩哔哩_bilibili"]
# Where a sentence ends.
SENTENCE_ENDS = [". ", "。", "; ", "；"]
# Longest site name, and the shortest title that is cut at a sentence.
TITLE_MARK = 33
# Patterns of hashtags, link lines and addresses.
HASHTAG = SPACE + r"#[\p{L}\p{N}_]+"
TRAILING_HASHTAGS = "(?:" + SPACE + r"+#[\p{L}\p{N}_]+#?)+$"
TAG_SYMBOLS = r"[^\p{L}\p{N}_]"
LINK_LINE = rf"^{SPACE}*(?:\d+\.)?{SPACE}*\[(.+)(?<!\\)\]{SPACE}*\((.+)\){SPACE}*$"
PLAIN_URL = rf"(https?://(?:(?!{SPACE}).)+)"
# Markup escapes, the ampersand first.
XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
REGEX_SPECIALS = r"([.*+?^${}()|\[\]\\])"


def clean_title(title: Column) -> Column:
    """Title -> struct(txt, sts): site suffix and hashtags become tags, long text is cut."""
    def body(raw: Column) -> Column:
        cut = F.greatest(*[last_index(raw, sep) for sep in SITE_SEPARATORS])

        def with_cut(at: Column) -> Column:
            has_suffix = at > F.greatest(F.lit(1), F.length(raw) - TITLE_MARK)
            suffix = F.when(has_suffix, F.array(F.concat(
                F.lit("suffix_"),
                F.regexp_replace(slice_text(raw, at, F.length(raw)), TAG_SYMBOLS, ""),
            ))).otherwise(F.array().cast("array<string>"))
            stem = F.when(has_suffix, trim_space(slice_text(raw, F.lit(0), at))).otherwise(raw)
            return let(stem, lambda s: F.struct(
                _cut_sentence(F.regexp_replace(s, TRAILING_HASHTAGS, "")).alias("txt"),
                F.concat(_leading_hash_tags(s), suffix).alias("sts"),
            ))

        return let(cut, with_cut)

    return let(title, body)


def _leading_hash_tags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({HASHTAG})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.substring(t, F.lit(2), F.length(t))))


def _cut_sentence(text: Column) -> Column:
    def cut(s: Column) -> Column:
        first_tick = first_index(s, "`", F.lit(0))
        second_tick = first_index(s, "`", first_tick + 1)
        start = F.greatest(F.lit(TITLE_MARK), F.coalesce(second_tick, F.lit(-1)))
        return let(start, lambda at: trim_space(slice_text(s, F.lit(0), F.coalesce(
            F.array_min(F.array(*[first_index(s, end, at) for end in SENTENCE_ENDS])),
            F.length(s)))))

    return let(text, cut)


def title_with_tags(text: Column, tags: Column) -> Column:
    """Text followed by those tags it does not already carry as hashtags."""
    def joined(own: Column) -> Column:
        missing = F.filter(array_or_empty(tags), lambda t: ~F.array_contains(own, F.lower(t)))
        return F.concat(text, F.lit(" "), F.array_join(F.transform(
            missing, lambda t: F.concat(F.lit(" "), F.regexp_replace(t, TAG_SYMBOLS, ""))), ""))

    found = F.regexp_extract_all(text, F.lit(f"({HASHTAG})"), F.lit(1))
    return let(F.transform(found, lambda t: F.lower(F.substring(t, F.lit(3), F.length(t)))), joined)


def split_tag_text(text: Column) -> Column:
    """Split on white space: words with a leading # -> txt, the others -> sts."""
    return let(F.split(text, f"{SPACE}+"), lambda words: F.struct(
        F.array_join(F.filter(words, lambda w: F.startswith(w, F.lit("#"))), " ").alias("txt"),
        F.filter(words, lambda w: ~F.startswith(w, F.lit("#"))).alias("sts"),
    ))


def url_domain(url: Column) -> Column:
    """Host of a web address; share host or drive of a file address."""
    slash = first_index(url, "/", F.lit(11))
    file_part = slice_text(url, F.lit(7), F.coalesce(slash, F.length(url) - 1))
    host = F.split(F.regexp_replace(url, r"(?s)^(.*?)https?://(www\.)?", "$1"), "/")[0]
    return F.when(F.startswith(url, F.lit("file:")), file_part).otherwise(host)


def link_line(line: Column) -> Column:
    """One markdown line ``[title](address)`` -> struct(title, ref), null when it is none."""
    ref = F.replace(F.regexp_extract(line, LINK_LINE, 2), F.lit("\\]("), F.lit("]("))
    return F.when(F.rlike(line, F.lit(LINK_LINE)), F.struct(
        F.regexp_extract(line, LINK_LINE, 1).alias("title"), ref.alias("ref")))


# Entities that are decoded by name; the ampersand last, so that nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
NUMBERED = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def unescape_html(text: Column) -> Column:
    """Entities by number and the common ones by name as the characters they stand for."""
    def character(n: Column) -> Column:
        code = F.when(F.lower(F.substring(n, 1, 1)) == "x", F.conv(F.substring(n, 2, 6), 16, 10)).otherwise(n).cast("int")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    parts = F.zip_with(F.split(text, NUMBERED, -1), F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)),
                       lambda gap, n: F.when(n.isNull(), gap).otherwise(F.concat(gap, character(n))))
    out = F.when(F.contains(text, F.lit("&#")), F.array_join(parts, "")).otherwise(text)
    for entity, raw in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return out


def extract_links(html: Column) -> Column:
    """Anchor targets, quoted or not, then plain addresses in the text, each once, in order."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), lambda x: unescape_html(
        F.regexp_replace(x, r"""^["']|["']$""", "")))
    text = unescape_html(F.regexp_replace(html, "<[^>]+>", " "))
    return F.array_distinct(F.concat(hrefs, F.regexp_extract_all(text, F.lit(PLAIN_URL), F.lit(1))))


def absolute_link(link: Column, page: Column) -> Column:
    """A link as seen from a page's address; dot segments are left as they are."""
    origin = F.regexp_extract(page, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([A-Za-z][\w+.-]*:)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    document = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path))
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    query = F.regexp_extract(page, r"(\?[^#]*)", 1)
    return (F.when(F.rlike(link, F.lit(r"^[A-Za-z][\w+.-]*:")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
            .when(F.startswith(link, F.lit("#")), F.concat(document, query, link))
            .when(F.startswith(link, F.lit("?")), F.concat(document, link))
            .otherwise(F.concat(origin, folder, link)))


def strip_html(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, "<[^>]+>", ""))


def escape_xml(text: Column) -> Column:
    for raw, escaped in XML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def feed_first_post(feed: Column, missing: str = "(no post found)") -> Column:
    """Text of the first card of type 9 in a JSON feed, without markup.

    Null, and so the fallback text, when that card has no text.
    """
    parsed = F.from_json(
        feed, "data struct<cards: array<struct<card_type: int, mblog: struct<text: string>>>>")
    first = F.get(F.filter(parsed["data"]["cards"], lambda c: c["card_type"] == 9), F.lit(0))
    text = first["mblog"]["text"]
    return F.when(F.length(text) > 0, strip_html(text)).otherwise(F.lit(missing))


def by_length(tags: Column) -> Column:
    """Longest tag first; equal lengths keep their order."""
    keyed = F.transform(tags, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def highlight_tags(text: Column, tags: Column) -> Column:
    """struct(matched, unmatched): tags found in the text (lower case), and the rest."""
    own = by_length(array_or_empty(tags))

    def split(sorted_tags: Column) -> Column:
        pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(
            sorted_tags, lambda t: F.regexp_replace(t, REGEX_SPECIALS, r"\\$1")), "|"), F.lit(")"))
        found = F.when(F.size(sorted_tags) > 0, F.array_distinct(F.transform(
            F.regexp_extract_all(text, pattern, F.lit(1)), F.lower))
        ).otherwise(F.array().cast("array<string>"))
        return let(found, lambda hit: F.struct(
            hit.alias("matched"),
            F.filter(sorted_tags, lambda t: ~F.array_contains(hit, F.lower(t))).alias("unmatched")))

    return let(own, split)
