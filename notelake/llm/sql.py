"""DuckDB equivalents of those training-data queries that SQL can express."""

from __future__ import annotations

from .decontam import _UPPER

_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
link AS (
  SELECT a AS u, b AS v FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.k + nb.k - shared)
),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)
),
least_doc AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM w JOIN least_doc USING (h) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
),
size AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d JOIN size ON len(ws) >= n)
),
hit AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = """
WITH t0 AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
t1 AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY role, text) AS k FROM t0),
t2 AS (SELECT *, CAST(floor(turn / 64) AS BIGINT) AS block, CAST(floor((k - 1) / 64) AS BIGINT) AS part FROM t1),
t AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY block, part, turn, k) AS o FROM t2),
ends AS (SELECT conv, max(o) AS o FROM t WHERE role = 'assistant' GROUP BY conv),
both_sides AS (
  SELECT t.*, e.o AS last, e.o IS NULL OR t.o <= e.o AS stays,
    CASE WHEN t.o = e.o THEN array_to_string(list_slice(string_split(text, ' '), 1, len(string_split(text, ' ')) // 2), ' ') ELSE text END AS weak
  FROM t LEFT JOIN ends e ON e.conv = t.conv
),
odd AS (SELECT conv, min(o) AS o FROM both_sides WHERE NOT stays OR weak <> text GROUP BY conv),
parted AS (SELECT b.*, d.o IS NULL OR b.o < d.o AS common FROM both_sides b LEFT JOIN odd d ON d.conv = b.conv),
said AS (
  SELECT conv, block, part, o, CASE WHEN common THEN 'prompt' ELSE 'chosen' END AS side, role, text FROM parted
  UNION ALL SELECT conv, block, part, o, 'rejected', role, weak FROM parted WHERE NOT common AND stays
),
put AS (
  SELECT *, '<|turn|>' || role || chr(10) || text || '<|end|>' || chr(10) AS rendered,
    sum(length(role) + length(text) + 17) OVER (PARTITION BY conv, block, part, side ORDER BY o) - length(text) - 8 AS start FROM said
),
flat AS (
  SELECT conv, block, part, side, count(*) AS n, string_agg(rendered, '' ORDER BY o) AS t,
    string_agg(CASE WHEN role = 'assistant' THEN start || ':' || (start + length(text) + 7) END, ',' ORDER BY o) AS spans
  FROM put GROUP BY ALL
)
SELECT conv AS pair_id, block, part, CAST(coalesce(sum(n) FILTER (side = 'prompt'), 0) AS BIGINT) AS n_prompt, CAST(coalesce(sum(n) FILTER (side = 'chosen'), 0) AS BIGINT) AS n_chosen,
  CAST(coalesce(sum(n) FILTER (side = 'rejected'), 0) AS BIGINT) AS n_rejected, sha256(coalesce(max(t) FILTER (side = 'prompt'), '')) AS prompt_sha256,
  sha256(coalesce(max(t) FILTER (side = 'chosen'), '')) AS chosen_sha256, sha256(coalesce(max(t) FILTER (side = 'rejected'), '')) AS rejected_sha256,
  coalesce(max(spans) FILTER (side = 'chosen'), '') AS chosen_spans, coalesce(max(spans) FILTER (side = 'rejected'), '') AS rejected_spans
FROM flat GROUP BY ALL
"""

OP9 = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS len FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT *, regexp_replace(trim(url, ' '), '#.*$', '') AS u FROM p),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^[^@]*@', ''), ':(?:80|443)$|^www\.', '', 'g') AS host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1), '\?$', '') AS rest FROM q
),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN rest IN ('', '/') THEN '' WHEN starts_with(rest, '?') THEN '/' || rest ELSE rest END END AS canon FROM c),
rev AS (SELECT * FROM k WHERE page_id % 3 <> 0 OR page_id % 9 = 0),
src AS (
  SELECT r.page_id, s.page_id AS source, s.digest AS old_digest, s.len AS old_len, row_number() OVER (PARTITION BY r.page_id ORDER BY s.page_id DESC) AS o
  FROM rev r JOIN k s ON s.canon = r.canon AND s.page_id * 60 < r.page_id * 60 + 600
),
m AS (
  SELECT r.*, source, old_digest, old_len, CASE WHEN r.page_id % 9 = 0 THEN '"changed"' ELSE 'W/"' || substr(r.digest, 1, 16) || '"' END AS tag,
    CASE WHEN source IS NULL THEN 'orphan' WHEN r.page_id % 9 <> 0 AND substr(r.digest, 1, 16) = substr(old_digest, 1, 16) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM rev r LEFT JOIN (SELECT * FROM src WHERE o = 1) s ON s.page_id = r.page_id
)
SELECT 'revisit-' || page_id AS record_id, url, status, CASE WHEN status = 'resolved' THEN 'page-' || source END AS refers_to,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600; content-length: ' || old_len || '; content-type: text/html; etag: ' || tag
    ELSE 'cache-control: max-age=600; content-type: text/plain; etag: ' || tag || '; server: edge' END AS headers,
  CASE WHEN status = 'resolved' THEN old_digest END AS payload_digest, CASE WHEN status = 'resolved' THEN old_len END AS payload_length
FROM m
"""

OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (
  SELECT r, i, md5(array_slice(x, i, i + 199)) AS h
  FROM (SELECT r, x, unnest(generate_series(1, octet_length(x) - 199)) AS i FROM d WHERE octet_length(x) >= 200)
),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w SEMI JOIN twice USING (h)),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
gone AS (SELECT r, run, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY r, run),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM gone),
kept AS (
  SELECT r, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(CASE WHEN a > e + 1 THEN hex(array_slice(x, e + 1, a - 1)) ELSE '' END, '' ORDER BY a) AS head
  FROM cut JOIN d USING (r) GROUP BY r
)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN last IS NULL THEN sha256(x)
    ELSE sha256(unhex(head || CASE WHEN last < octet_length(x) THEN hex(array_slice(x, last + 1, octet_length(x))) ELSE '' END)) END AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 of the decimal digits, bit by bit.
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP12 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_field("text")}) AS d,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FIELDS} || {_field(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")}) END AS t
  FROM documents
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS r, count(*) OVER (PARTITION BY source) AS total FROM leaf
),
node(source, k, r, total, d) AS (
  SELECT source, 0, r, total, d FROM numbered
  UNION ALL
  SELECT source, k + 1, r // 16, (any_value(total) + 15) // 16, sha256(string_agg(d, '' ORDER BY r)) FROM node WHERE total > 1 GROUP BY source, k, r // 16
),
top AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS total FROM node WHERE total = 1),
high(k, r, total, d) AS (
  SELECT 0, r, total, d FROM top
  UNION ALL
  SELECT k + 1, r // 16, (any_value(total) + 15) // 16, sha256(string_agg(d, '' ORDER BY r)) FROM high WHERE total > 1 GROUP BY k, r // 16
),
root AS (SELECT d FROM high WHERE total = 1),
-- Each node with its siblings to the left and to the right.
side AS (
  SELECT source, k, r, total, coalesce(string_agg(d, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(d, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM node WHERE total > 1 WINDOW l AS (PARTITION BY source, k, r // 16 ORDER BY r)
),
high_side AS (
  SELECT k, r, total, coalesce(string_agg(d, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(d, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM high WHERE total > 1 WINDOW l AS (PARTITION BY k, r // 16 ORDER BY r)
),
path(source, r0, k, r, proof, f) AS (
  SELECT source, r, 0, r, '', coalesce(t, d) FROM numbered
  UNION ALL
  SELECT p.source, p.r0, p.k + 1, p.r // 16, p.proof || s.a || s.z, sha256(s.a || p.f || s.z)
  FROM path p JOIN side s ON s.source IS NOT DISTINCT FROM p.source AND s.k = p.k AND s.r = p.r
),
under AS (SELECT source, r0, proof, f FROM path QUALIFY k = max(k) OVER (PARTITION BY source, r0)),
over_path(source, r0, k, r, proof, f) AS (
  SELECT u.source, r0, 0, t.r, proof, f FROM under u JOIN top t ON t.source IS NOT DISTINCT FROM u.source
  UNION ALL
  SELECT p.source, p.r0, p.k + 1, p.r // 16, p.proof || s.a || s.z, sha256(s.a || p.f || s.z) FROM over_path p JOIN high_side s ON s.k = p.k AND s.r = p.r
),
whole AS (SELECT source, r0, proof, f FROM over_path QUALIFY k = max(k) OVER (PARTITION BY source, r0))
SELECT n.doc_id, n.d AS leaf, t.d AS subroot, root.d AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = root.d AS verified
FROM numbered n JOIN whole w ON w.source IS NOT DISTINCT FROM n.source AND w.r0 = n.r JOIN top t ON t.source IS NOT DISTINCT FROM n.source CROSS JOIN root
"""

SQL: dict[str, str] = {
    "op1_near_duplicates": OP1, "op3_repeated_passages": OP3, "op7_decontamination": OP7, "op8_preference_format": OP8, "op9_warc_revisits": OP9,
    "op11_suffix_dedup": OP11, "op12_merkle_manifest": OP12,
}
