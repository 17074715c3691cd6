"""The derived views of ``views.py`` as SQL, for checks in another engine."""

from __future__ import annotations

import re

DAY0 = "TIMESTAMP '2024-01-01'"
DOC_DT = f"({DAY0} + to_days(CAST(doc_id % 30 AS INTEGER)))"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def joined(column: str) -> str:
    return f"array_to_string({column}, '|')"


VIEWS = {
    "tags_documents": f"""
        SELECT doc_id AS tid, text AS txt, source || '/' || doc_id AS ref, [lang, source] AS sts,
               {DOC_DT} AS dt, lang AS type FROM documents""",
    "tags_dups": f"""
        SELECT doc_id AS tid, text AS txt, source AS ref, [lang, source] AS sts,
               {DOC_DT} AS dt, lang AS type FROM documents""",
    "tags_events": """
        SELECT event_id AS tid, event_type AS txt, 'user/' || user_id AS ref,
               [event_type, 'dev_' || (event_id % 4)] AS sts, date_trunc('day', ts) AS dt,
               event_type AS type FROM events""",
    "tags_pages": r"""
        SELECT page_id AS tid,
               regexp_extract(html, '<title>([^<]*)</title>', 1) || ' #'
               || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) || ' - '
               || regexp_extract(url, '^https?://([^/]+)', 1) AS txt,
               url AS ref, [regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1),
               regexp_extract(url, '^https?://([^/]+)', 1)] AS sts, 'tab' AS type FROM pages""",
    "server_snap": "SELECT * FROM tags_documents",
    "local_snap": """
        SELECT CASE WHEN tid % 10 IN (8, 9) THEN -tid - 1 ELSE tid END AS tid,
               CASE WHEN tid % 10 = 5 THEN txt || ' edited' ELSE txt END AS txt,
               CASE WHEN tid % 10 = 8 THEN 'local/' || tid ELSE ref END AS ref,
               sts, dt, type FROM tags_documents""",
    "base": """
        SELECT CASE WHEN tid % 5 = 4 THEN -tid - 1 ELSE tid END AS tid,
               CASE WHEN tid % 20 = 8 THEN 'server ' || txt ELSE txt END AS txt,
               CASE WHEN tid % 5 = 4 THEN 'server/' || tid ELSE ref END AS ref,
               sts, dt, type, dt - INTERVAL 1 DAY AS prev_dt, tid AS doc_id FROM tags_documents""",
    "local_sync": """
        SELECT tid,
               CASE WHEN tid % 20 IN (0, 1, 8) THEN txt || ' local' ELSE txt END AS txt,
               CASE WHEN tid % 20 = 2 THEN 'local/' || tid ELSE ref END AS ref, sts,
               CASE WHEN tid % 20 IN (1, 8) THEN dt - INTERVAL 1 DAY
                    WHEN tid % 20 IN (2, 4) THEN NULL ELSE dt END AS dt,
               type, tid % 20 IN (0, 1, 2, 4, 8) AS dirty,
               tid % 20 = 8 AS has_origin, dt - INTERVAL 1 DAY AS origin_dt, txt AS origin_txt,
               tid AS doc_id FROM tags_documents""",
    "cdc_events": """
        SELECT event_id AS seq, user_id AS tid,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
               value, ts FROM events""",
    "durations": "SELECT event_type AS scope, ts, event_id AS id, value AS ms FROM events",
    "bursts": "SELECT user_id AS key, ts, event_id AS id, value FROM events",
    "vecs": "SELECT vec_id AS tid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "vecs_held": """
        SELECT tid, CASE WHEN tid % 3 = 0 THEN (SELECT arg_min(vec, tid) FROM vecs) ELSE vec END AS vec FROM vecs""",
    "vecs_copied": """
        SELECT tid, vec FROM vecs_held UNION ALL SELECT -tid - 1, vec FROM vecs_held WHERE tid % 10 = 1""",
    "models": "SELECT *, CASE WHEN tid % 3 = 0 THEN 'small' ELSE 'large' END AS mdl FROM vecs",
    "md_documents": r"""
        SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
               lambda line, i: CASE (i - 1) % 4 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '> ' ELSE '' END || line),
               chr(10)) AS text FROM documents""",
    "segments": r"""
        SELECT doc_id, CAST(unnest(generate_series(0, len(segs) - 1)) AS BIGINT) AS seq, unnest(segs) AS seg
        FROM (SELECT doc_id, regexp_extract_all(text, '([^\n]*\n|[^\n]+)', 1) AS segs FROM md_documents)""",
}


def with_views(sql: str) -> str:
    """Put the views a statement names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
