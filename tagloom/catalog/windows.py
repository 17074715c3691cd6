"""Context windows, neighbours, segment offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, documents, similarity
from ..plans.shared import through_table
from . import views
from .joins import PAIRS
from .registry import query

EDGES = """SELECT src, dst, round(w, 6) AS w, row_number() OVER (PARTITION BY src ORDER BY round(w, 12) DESC, dst) AS rank
           FROM ({}) p WHERE w >= 0.3 QUALIFY rank <= 6"""
EDGES_WITH_COPIES = EDGES.format(PAIRS.replace("vecs", "vecs_copied"))
EDGES_BY_MODEL = EDGES.format(PAIRS.replace("vecs", "models") + " AND a.mdl = b.mdl")


@query("rows_around", """
    SELECT tid, txt FROM (
        (SELECT tid, txt FROM tags_documents WHERE tid > 100 ORDER BY tid LIMIT 16)
        UNION ALL (SELECT tid, txt FROM tags_documents WHERE tid = 100)
        UNION ALL (SELECT tid, txt FROM tags_documents WHERE tid < 100 ORDER BY tid DESC LIMIT 16)) x""")
def rows_around(spark, folder):
    return context.rows_around(views.tags_documents(spark, folder), 100).select("tid", "txt")


@query("rows_around_each", """
    WITH keys AS (SELECT tid, row_number() OVER (ORDER BY tid) AS pos FROM local_snap),
         a AS (SELECT k.tid, k.pos FROM keys k WHERE k.tid IN (SELECT doc_id FROM labels))
    SELECT a.tid AS anchor, k.tid FROM a JOIN keys k ON k.pos BETWEEN a.pos - 16 AND a.pos + 16""")
def rows_around_each(spark, folder):
    anchors = views.table(spark, folder, "labels").select(F.col("doc_id").alias("tid"))
    return context.rows_around_each(views.local_snap(spark, folder), anchors)


@query("topk_neighbours", EDGES_WITH_COPIES)
def topk_neighbours(spark, folder):
    """Of vectors of which more than a third are copies."""
    vectors = views.vecs_copied(spark, folder)
    pairs = similarity.cosine_pairs(vectors, 0.2)
    return similarity.topk_neighbours(pairs, 6, 0.3, vectors).select(
        "src", "dst", F.round("w", 6).alias("w"), F.col("rank").cast("bigint").alias("rank"))


@query("similarity_graph", f"SELECT e.*, m.mdl FROM ({EDGES_BY_MODEL}) e JOIN models m ON m.tid = e.src")
def similarity_graph(spark, folder):
    """The graph of each model by itself."""
    graph = similarity.per_model(views.models(spark, folder), similarity.similarity_graph, threshold=0.3)
    return graph.select("src", "dst", F.round("w", 6).alias("w"), F.col("rank").cast("bigint").alias("rank"), "mdl")


@query("segment_offsets", """
    SELECT doc_id, seq, length(seg) AS len, CAST(coalesce(sum(length(seg)) OVER (
               PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM segments""")
def segment_offsets(spark, folder):
    """Offsets of a stored table of segments; cutting the texts is done once, before."""
    segments = documents.segment_documents(views.md_documents(spark, folder)).select("doc_id", "seq", "seg")
    return documents.segment_offsets(through_table(segments, "segments"))
