"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.shared import fresh_path
from . import bpe, decontaminate, jaccard, langid, licenses, merkle, pii, prefixes, quality, tokencounts, topk, toxicity, urls
from .common import table
from .registry import query


@query("op1_quality_classifier")
def quality_classifier(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_toxicity")
def toxicity_classifier(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_license_scan")
def license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("detections")


@query("op10_token_counts")
def token_counts(spark, folder):
    """Starts from an empty cache, so that every distinct text is encoded in each run."""
    return tokencounts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))


@query("op7_byte_bpe")
def byte_bpe(spark, folder):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    told = coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return bpe.decode(told, ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_ngram_jaccard_join", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^ \t\n\v\f\r]+') AS w FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
    x AS (SELECT doc_id, unnest(s) AS g FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
    e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
    FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id""")
def ngram_jaccard_join(spark, folder):
    return jaccard.similar(table(spark, folder, "documents"), 4, 85)


@query("op5_decontamination")
def decontamination(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_pii")
def personal_data(spark, folder):
    """Counts are of base spans; ``n_added`` has those of the method."""
    found = pii.find(table(spark, folder, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
        pii.told(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


@query("op3_url_filters")
def url_filters(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query("op2_topk_search", """
    WITH v AS (
        SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5""")
def topk_search(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), 50, 5)


@query("op11_conversation_trie", """
    WITH o AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, coalesce(role, ''),
                   sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
        SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(
            list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
            lambda x, byte: list_reduce(list_transform(range(8), lambda i: CAST(i AS BIGINT)),
                lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(x, byte)), 4294967295), 4294967295) % 6 AS h
        FROM o),
    r AS (
        SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.head AND o.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
    s AS (
        SELECT c.conv_id, coalesce(list({'r': r.role, 't': r.text} ORDER BY part, pos) FILTER (r.pos IS NOT NULL), []) AS turns
        FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
    m AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
    n AS (
        SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends
        FROM m GROUP BY 1, 2),
    k AS (
        SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children
        FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1])
    SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children,
           count(*) FILTER (x.n_children = 0) AS n_leaves,
           CAST(sum(CASE WHEN x.depth > 0 THEN (x.n_convs - 1) * length(x.path[x.depth].t) ELSE 0 END) AS BIGINT) AS saved_tokens,
           sha256(coalesce(k.ends, '')) AS ends_sha256
    FROM k JOIN k x ON x.depth >= k.depth AND x.path[1:k.depth] = k.path GROUP BY ALL""")
def conversation_trie(spark, folder):
    return prefixes.trie(table(spark, folder, "conversations"))


@query("op12_language_id")
def language_id(spark, folder):
    return langid.predict(table(spark, folder, "documents"))


@query("op13_merkle_manifest")
def merkle_manifest(spark, folder):
    """Tampering lower-cases A-Z where 3 divides crc32 of the id."""
    docs = table(spark, folder, "documents")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(chosen, F.translate("text", merkle.CAPITALS, merkle.SMALL)).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest(docs, text))
