"""The training-data queries, and their SQL where SQL can express them."""

from __future__ import annotations

from .fm_index import op7_decontamination
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import op3_ngram_join
from .ogg import op8_ogg_media
from .packing import op5_best_fit_packing
from .quality import op4_importance_resampling
from .sharding import op1_sharding
from .tokens import op10_token_ids
from .urls import OP2_SQL, op2_url_filter
from .warc import OP6_SQL, op6_warc

QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_url_filter, op3_ngram_join, op4_importance_resampling, op5_best_fit_packing, op6_warc, op7_decontamination, op8_ogg_media, op9_line_dedup, op10_token_ids)
}

# Word sets and links of all pairs that share a shingle; components by recursion.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
wi AS (
  SELECT DISTINCT item, least(len(t), 10) AS k, unnest(list_transform(range(1, greatest(len(t) - 9, 1) + 1), lambda i: array_to_string(t[i:i + 9], ' '))) AS g
  FROM bw WHERE len(t) > 0),
ks AS (SELECT DISTINCT k FROM wi),
dg AS (
  SELECT doc_id, k, unnest(range(1, len(t) - k + 2)) AS i, unnest(list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' '))) AS g
  FROM dw, ks WHERE len(t) >= k),
m AS (SELECT doc_id, item, i, k FROM dg JOIN wi USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT dw.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES = {"op2_url_filter": OP2_SQL, "op3_ngram_join": OP3_SQL, "op6_warc": OP6_SQL, "op7_decontamination": OP7_SQL, "op9_line_dedup": OP9_SQL}
