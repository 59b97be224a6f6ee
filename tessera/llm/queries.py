"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .compression_classifier import op6_quality_classifier
from .html_extract import op1_html_text
from .jaccard_join import op5_jaccard_join
from .media_chunks import op4_media_chunks
from .mixing import op9_mix_sources
from .pseudonyms import op2_pseudonyms
from .quality_rules import op7_quality_rules
from .suffix_dedup import op10_suffix_dedup
from .url_filter import op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_url_filter": op3_url_filter,
    "op4_media_chunks": op4_media_chunks,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_mix_sources": op9_mix_sources,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op10_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(0, n - 49)) AS pos, x FROM h WHERE n >= 50),
k AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS piece FROM s),
f AS (SELECT piece, min(doc_id) AS first FROM k GROUP BY piece HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT k.doc_id, k.pos FROM k JOIN f ON f.piece = k.piece WHERE f.first < k.doc_id),
e AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM e),
v AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY doc_id, island),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM v),
q AS (SELECT h.doc_id, h.n, sum(o.b - o.a) AS gone, count(o.a) AS spans,
      coalesce(string_agg(substr(h.x, 2 * o.was + 1, 2 * (o.a - o.was)), '' ORDER BY o.a), '') || substr(any_value(h.x), 2 * coalesce(max(o.b), 0) + 1) AS kept
      FROM h LEFT JOIN o ON o.doc_id = h.doc_id GROUP BY h.doc_id, h.n)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM q""",
}
