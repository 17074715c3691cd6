"""Rows from titles, links and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import absolute_link, clean_title, extract_links, link_line

# Fixed value: tag of rows that were pasted as markdown.
PASTED_TAG = "markdown_pasted"


def title_to_tab(rows: DataFrame, title: str = "title", ref: str = "ref") -> DataFrame:
    """(txt, sts, ref) with the title cleaned and its tags taken out."""
    return (rows.withColumn("_c", clean_title(F.col(title)))
            .select(*[c for c in rows.columns if c not in (title, ref)],
                    F.col("_c.txt").alias("txt"), F.col("_c.sts").alias("sts"), F.col(ref).alias("ref")))


def ingest_md_links(docs: DataFrame, text: str, now) -> DataFrame:
    """Rows of type 'tab' for each line ``[title](address)``; other columns are kept."""
    others = [c for c in docs.columns if c != text]
    found = (docs.select(*others, F.explode(F.split(text, r"\r?\n")).alias("_line"))
             .withColumn("_link", link_line(F.col("_line"))).where("_link is not null")
             .select(*others, "_link.title", "_link.ref"))
    return (title_to_tab(found)
            .withColumn("sts", F.concat(F.array(F.lit(PASTED_TAG)), "sts"))
            .withColumn("type", F.lit("tab")).withColumn("dt", F.lit(now).cast("timestamp")))


def page_links(pages: DataFrame, html: str = "html", keep: list[str] | None = None,
               url: str | None = None) -> DataFrame:
    """One row per link of a page, in order of first sight.

    Links are given as written; with ``url``, the column of the page's address, as
    absolute addresses, and two ways to write one address count once.
    """
    kept: list[str | Column] = list(keep or [c for c in pages.columns if c != html])
    found = extract_links(F.col(html))
    if url is not None:
        found = F.array_distinct(F.transform(found, lambda link: absolute_link(link, F.col(url))))
    return pages.select(*kept, F.posexplode(found).alias("place", "link"))
