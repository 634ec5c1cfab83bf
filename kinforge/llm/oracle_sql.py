"""DuckDB SQL for the operators that SQL can express on whole tables (brute force over every window)."""

from __future__ import annotations

from .hamming_search import SQL as HAMMING

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes as two hexadecimal digits each, so that any byte can stand in a string.
SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w SEMI JOIN again USING (k)),
part AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 200 AS new FROM hit),
grp AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM part),
span AS MATERIALIZED (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM grp GROUP BY doc_id, g),
piece AS (SELECT doc_id, g, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, a FROM span UNION ALL SELECT doc_id, 1000000000, max(b), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(substr(d.x, 2 * c + 1, 2 * (least(a, length(d.x)) - c)), '' ORDER BY g) AS x FROM piece p JOIN d USING (doc_id) GROUP BY p.doc_id),
cnt AS (SELECT doc_id, sum(b - a) AS n, count(*) AS s FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

PHRASE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens)),
hit AS MATERIALIZED (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
cnt AS (SELECT doc_id, count(*) AS h FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL = {"op1_suffix_dedup": SUFFIX, "op2_phrase_dedup": PHRASE, "op3_decontaminate": CONTAMINATION, "op10_hamming_topk": HAMMING}
