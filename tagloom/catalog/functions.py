"""Scalar functions, documents and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, tags as tagfns, text, vectors
from ..operators import documents, links
from . import views
from .registry import query


# Site separators as list literals: where each last occurs, without regular expressions.
_SEPARATORS = ", ".join("'" + sep + "'" for sep in text.SITE_SEPARATORS)
CLEAN = rf"""
    titled AS (SELECT tid, ref, txt AS t FROM tags_pages),
    cut AS (SELECT *, list_max(list_transform([{_SEPARATORS}], lambda s: CASE WHEN contains(t, s)
                THEN length(t) - strpos(reverse(t), reverse(s)) - length(s) + 1 ELSE -1 END)) AS cutoff FROM titled),
    stem AS (SELECT *, cutoff > greatest(1, length(t) - 33) AS has,
                CASE WHEN cutoff > greatest(1, length(t) - 33)
                     THEN regexp_replace(t[:cutoff], '^\s+|\s+$', '', 'g') ELSE t END AS s FROM cut),
    tagged AS (SELECT *, regexp_extract_all(s, '\s(#[\p{{L}}\p{{N}}_]+)', 1) AS found,
                regexp_replace(s, '(?:\s+#[\p{{L}}\p{{N}}_]+#?)+$', '') AS b FROM stem),
    ended AS (SELECT *, list_min(list_filter(list_transform(['. ', '。', '; ', '；'],
                lambda e: strpos(b[34:], e)), lambda p: p > 0)) AS stop FROM tagged),
    cleaned AS (SELECT tid, ref, regexp_replace(CASE WHEN stop IS NULL THEN b ELSE b[:32 + stop] END, '^\s+|\s+$', '', 'g') AS txt,
                array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i)
                    || CASE WHEN has THEN ['suffix_' || regexp_replace(t[cutoff + 1:], '[^\p{{L}}\p{{N}}_]', '', 'g')]
                            ELSE [] END, '|') AS sts FROM ended)"""


@query("clean_title", f"WITH {CLEAN} SELECT tid, txt, sts FROM cleaned")
def clean_title(spark, folder):
    return views.tags_pages(spark, folder).select("tid", text.clean_title(F.col("txt")).alias("c")).select(
        "tid", "c.txt", "c.sts")


@query("title_to_tab", f"WITH {CLEAN} SELECT tid, txt, sts, ref FROM cleaned")
def title_to_tab(spark, folder):
    return links.title_to_tab(
        views.tags_pages(spark, folder).select("tid", F.col("txt").alias("title"), "ref"))


@query("title_with_tags", r"""
    WITH own AS (SELECT *, list_transform(regexp_extract_all(txt, '\s#([\p{L}\p{N}_]+)', 1), lambda t: lower(t)) AS have
                 FROM tags_pages)
    SELECT tid, txt || ' ' || coalesce(array_to_string(list_transform(
               list_filter(sts, lambda t: NOT list_contains(have, lower(t))),
               lambda t: ' ' || regexp_replace(t, '[^\p{L}\p{N}_]', '', 'g')), ''), '') AS txt FROM own""")
def title_with_tags(spark, folder):
    return views.tags_pages(spark, folder).select(
        "tid", text.title_with_tags(F.col("txt"), F.col("sts")).alias("txt"))


@query("split_tag_text", r"""
    WITH w AS (SELECT tid, regexp_split_to_array(txt, '\s+') AS words FROM tags_pages)
    SELECT tid, array_to_string(list_filter(words, lambda x: starts_with(x, '#')), ' ') AS txt,
           array_to_string(list_filter(words, lambda x: NOT starts_with(x, '#')), '|') AS sts FROM w""")
def split_tag_text(spark, folder):
    return views.tags_pages(spark, folder).select("tid", text.split_tag_text(F.col("txt")).alias("s")).select(
        "tid", "s.txt", "s.sts")


@query("url_domain", r"""
    SELECT page_id, string_split(regexp_replace(url, 'https?://(www\.)?', ''), '/')[1] AS domain,
           'ex' || page_id || '.com' AS share FROM pages""")
def url_domain(spark, folder):
    share = F.concat(F.lit("file://ex"), F.col("page_id").cast("string"), F.lit(".com/some/file"))
    return views.table(spark, folder, "pages").select(
        "page_id", text.url_domain(F.col("url")).alias("domain"), text.url_domain(share).alias("share"))


@query("highlight_tags", r"""
    WITH t AS (SELECT tid, txt, CASE WHEN length(sts[2]) > length(sts[1]) THEN [sts[2], sts[1]] ELSE sts END AS own
               FROM tags_pages),
    m AS (SELECT *, list_transform(regexp_extract_all(txt, '(?i)(' || replace(own[1], '.', '\.') || '|'
                 || replace(own[2], '.', '\.') || ')', 1), lambda x: lower(x)) AS hits FROM t)
    SELECT tid, array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), '|') AS matched,
           coalesce(array_to_string(list_filter(own, lambda x: NOT list_contains(hits, lower(x))), '|'), '') AS unmatched
    FROM m""")
def highlight_tags(spark, folder):
    return views.tags_pages(spark, folder).select(
        "tid", text.highlight_tags(F.col("txt"), F.col("sts")).alias("h")).select("tid", "h.matched", "h.unmatched")


@query("uniq_key", "SELECT tid, type, ref FROM tags_documents")
def uniq_key(spark, folder):
    return views.tags_documents(spark, folder).select("tid", tagfns.uniq_key().alias("k")).select("tid", "k.*")


@query("content_key", """
    SELECT s.tid, count(*) AS n FROM server_snap s JOIN local_snap l
    ON l.ref = s.ref AND l.txt = s.txt AND l.type = s.type AND l.sts = s.sts GROUP BY s.tid""")
def content_key(spark, folder):
    key = tagfns.content_digest().alias("key")
    server = views.server_snap(spark, folder).select("tid", key)
    local = views.local_snap(spark, folder).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return server.join(local, "key").select("tid", "n")


@query("strip_html", r"""
    SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def strip_html(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("escape_xml", """
    SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
           '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def escape_xml(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.escape_xml(F.col("html")).alias("xml"))


@query("diff_days", """
    SELECT event_id, (epoch_ms(TIMESTAMP '2024-05-01 12:00:00') - (epoch_us(ts) // 1000)) / CAST(86400000 AS DOUBLE) AS days FROM events""")
def diff_days(spark, folder):
    days = dates.diff_days(views.at(views.NOW), F.col("ts"))
    return views.table(spark, folder, "events").select("event_id", days.alias("days"))


def _order_dates(spark, folder, *columns):
    return views.table(spark, folder, "orders").withColumn(
        "dt", F.col("o_orderdate") + F.make_interval(mins=F.col("o_orderkey").cast("int"))).select(
        "o_orderkey", *columns)


ORDER_DT = "(o_orderdate + to_minutes(CAST(o_orderkey AS INTEGER)))"


@query("fmt_ym", f"SELECT o_orderkey, strftime({ORDER_DT}, '%Y-%m') AS shown FROM orders")
def fmt_ym(spark, folder):
    return _order_dates(spark, folder, dates.fmt_ym(F.col("dt")).alias("shown"))


@query("fmt_mdwhm", f"""
    SELECT o_orderkey, strftime({ORDER_DT}, '%Y ') || lpad(CAST(month({ORDER_DT}) AS VARCHAR), 2, ' ')
           || strftime({ORDER_DT}, '/%d %a %H:%M') AS shown FROM orders""")
def fmt_mdwhm(spark, folder):
    return _order_dates(spark, folder, dates.fmt_mdwhm(F.col("dt")).alias("shown"))


@query("fmt_md", f"SELECT o_orderkey, month({ORDER_DT}) || strftime({ORDER_DT}, '/%d') AS shown FROM orders")
def fmt_md(spark, folder):
    return _order_dates(spark, folder, dates.fmt_md(F.col("dt")).alias("shown"))


@query("date_parts", f"""
    SELECT o_orderkey, CAST(year({ORDER_DT}) AS INTEGER) AS year, CAST(month({ORDER_DT}) AS INTEGER) AS month,
           CAST(day({ORDER_DT}) AS INTEGER) AS day, strftime({ORDER_DT}, '%a') AS weekday,
           CAST(hour({ORDER_DT}) AS INTEGER) AS hour, CAST(minute({ORDER_DT}) AS INTEGER) AS minute FROM orders""")
def date_parts(spark, folder):
    return _order_dates(spark, folder, dates.date_parts(F.col("dt")).alias("p")).select("o_orderkey", "p.*")


@query("string_tags_lines", """
    SELECT tid, array_to_string(sts, chr(10)) AS lines, array_to_string(sts, '|') AS back FROM tags_events""")
def string_tags_lines(spark, folder):
    lines = tagfns.tags_to_lines(F.col("sts"))
    return views.tags_events(spark, folder).select(
        "tid", lines.alias("lines"), tagfns.lines_to_tags(F.concat(F.lit("\n"), lines)).alias("back"))


@query("cosine", """
    SELECT a.tid, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec))
           * sqrt(list_dot_product(b.vec, b.vec))), 6) AS w FROM vecs a JOIN vecs b ON b.tid = a.tid + 1""")
def cosine(spark, folder):
    vecs = views.vecs(spark, folder)
    following = vecs.select((F.col("tid") - 1).alias("tid"), F.col("vec").alias("other"))
    return vecs.join(following, "tid").select(
        "tid", F.round(vectors.cosine(F.col("vec"), F.col("other")), 6).alias("w"))


OFFSETS = """CAST(coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"""
KIND = r"""CASE WHEN regexp_matches(seg, '^(```|~~~| {4}|\t)') THEN 'code'
                WHEN regexp_matches(seg, '^ {0,3}#{1,6}(\s|$)') THEN 'heading'
                WHEN regexp_matches(seg, '^\s*([-*+]|\d+[.)])\s') THEN 'listItem'
                WHEN regexp_matches(seg, '^ {0,3}>') THEN 'blockquote'
                WHEN regexp_matches(seg, '^\s*</?[A-Za-z!]') THEN 'html'
                WHEN regexp_matches(seg, '^\s*\[[^\]]+\]\([^)]+\)\s*$') THEN 'link' ELSE 'paragraph' END"""


@query("segment_documents", f"SELECT doc_id, seq, {OFFSETS} AS start, seg, {KIND} AS kind FROM segments")
def segment_documents(spark, folder):
    return documents.segment_documents(views.md_documents(spark, folder))


@query("rebuild_documents", "SELECT doc_id, text, TRUE AS same FROM md_documents")
def rebuild_documents(spark, folder):
    docs = views.md_documents(spark, folder)
    rebuilt = documents.rebuild_documents(documents.segment_documents(docs))
    return rebuilt.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").select(
        "doc_id", "text", F.col("text").eqNullSafe(F.col("was")).alias("same"))


@query("segment_tags", rf"""
    WITH s AS (SELECT doc_id, seq, {OFFSETS} AS start, {KIND} AS kind, regexp_replace(seg, '\n$', '') AS body FROM segments),
    v AS (SELECT *, regexp_replace(body, '^\s*(#{{1,6}}|[-*+]|\d+[.)]|>)\s*', '') AS val FROM s)
    SELECT doc_id, seq, '#' || kind || ';' || kind || '_' || lower(to_base(seq + 1, 36)) || '|#ref=' || kind
           || '|#seq=' || start || '|#parent=root' || CASE WHEN val <> '' THEN '|#val=' || val ELSE '' END
           || CASE WHEN regexp_extract(body, '\]\(([^)]+)\)', 1) <> ''
                   THEN '|#meta=url:' || regexp_extract(body, '\]\(([^)]+)\)', 1) ELSE '' END
           || CASE WHEN regexp_extract(body, '^(?:```|~~~)\s*(\w+)', 1) <> ''
                   THEN '|#meta=lang:' || regexp_extract(body, '^(?:```|~~~)\s*(\w+)', 1) ELSE '' END
           || CASE WHEN length(regexp_extract(body, '^ {{0,3}}(#{{1,6}})(?:\s|$)', 1)) > 0
                   THEN '|#meta=level:' || length(regexp_extract(body, '^ {{0,3}}(#{{1,6}})(?:\s|$)', 1)) ELSE '' END AS tags
    FROM v""")
def segment_tags(spark, folder):
    segments = documents.segment_documents(views.md_documents(spark, folder))
    return documents.tag_segments(segments).select("doc_id", "seq", "tags")


@query("outline_records", """
    SELECT event_id, '- **user**: ' || user_id || chr(10) || '- **p**: ' || chr(10) || '  - **k**: '
           || json_extract_string(props, '$.k') || chr(10) || '- **kinds**: ' || chr(10) || '  - ' || event_type
           || chr(10) || '  - **z**: 1' || chr(10) || '  - **a**: null' AS outline FROM events""")
def outline_records(spark, folder):
    return documents.outline_records(views.records(spark, folder).repartition("event_id")).select("event_id", "outline")
