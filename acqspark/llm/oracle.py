"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hexed AS (SELECT page_id, b, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS winner FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM hexed
"""

# Host rates use the same moment estimate of the beta prior as the operator.
_QUALITY = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win2 WHERE c > 1) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(c - 1) AS n, sum(c) AS lines FROM (SELECT doc_id, l, count(*) AS c FROM line WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id, l) GROUP BY doc_id),
f AS (SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.lines, 0)::BIGINT AS n_lines
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
r AS (SELECT *, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_lines,
                        word_chars > 12 * n_words OR word_chars < 2 * n_words]) AS bad, unnest(range(5)) AS rule FROM f),
h AS (SELECT host, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS x FROM r WHERE host IS NOT NULL GROUP BY host, rule),
t AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(n * n) AS nn, least(greatest(sum(x) / sum(n), 1e-9), 1 - 1e-9) AS p FROM h GROUP BY rule),
s AS (SELECT t.*, (SELECT sum(h.n * (h.x / h.n - p) * (h.x / h.n - p)) FROM h WHERE h.rule = t.rule) AS spread FROM t),
q AS (SELECT rule, p, least(greatest(CASE WHEN n - nn / n - (k - 1) > 0 THEN (spread / (p * (1 - p)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0.5 END, 1e-6), 0.999) AS rho FROM s),
v AS (SELECT host, max(rate) <= 0.8 AS ok, bool_or(rule = 2 AND rate < 0.9 * p) AS symbols, bool_or(rule = 3 AND rate < 0.9 * p) AS dup_lines,
             bool_or(rule = 4 AND rate < 0.9 * p) AS word_length
      FROM (SELECT host, rule, p, (x + p * (1 / rho - 1)) / (h.n + 1 / rho - 1) AS rate FROM h JOIN q USING (rule)) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(ok, true) AND NOT (10 * n_symbols > n_words AND NOT coalesce(symbols, false))
       AND NOT (2 * n_dup_lines > n_lines AND NOT coalesce(dup_lines, false))
       AND NOT ((word_chars > 12 * n_words OR word_chars < 2 * n_words) AND NOT coalesce(word_length, false)) AS kept
FROM f LEFT JOIN v USING (host)
"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

# Turns of one number come in the order of their digest, as in the operator.
_TRIE = """
WITH tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
                    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turn AS (SELECT conv_id, turn, length(x) AS len, substr(sha256(length(r)::VARCHAR || ':' || r || x), 1, 32) AS digest
         FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'d': digest, 'n': len} ORDER BY turn NULLS FIRST, digest) AS ts FROM turn GROUP BY conv_id),
cut AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, tab),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(p.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM cut c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (SELECT conv_id, ts[1:d] AS k, d, d = len(ts) AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
node AS (SELECT k, d, min(conv_id) AS c, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefix GROUP BY k, d),
kid AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
one AS (SELECT node.*, coalesce(kid.n, 0) AS kids, CASE WHEN d > 0 THEN (node.n - 1) * node.k[d].n ELSE 0 END AS saved FROM node LEFT JOIN kid USING (k)),
tree AS (SELECT k[1:u] AS k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT k, saved, kids, unnest(range(0, d + 1)) AS u FROM one) GROUP BY 1)
SELECT one.c::BIGINT AS conv_id, one.d::BIGINT AS depth, up.c::BIGINT AS parent_conv_id, one.n::BIGINT AS n_convs, one.kids::BIGINT AS n_children,
       tree.leaves::BIGINT AS n_leaves, tree.saved::BIGINT AS saved_tokens, sha256(one.ids) AS ends_sha256
FROM one JOIN tree ON tree.k = one.k LEFT JOIN node up ON one.d > 0 AND up.k = one.k[1:one.d - 1]
"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL = {"op2_archive_conversion": _ARCHIVES, "op4_quality_rules": _QUALITY, "op6_minhash": _NEAR, "op11_prefix_trie": _TRIE, "op13_hard_negatives": _NEGATIVES}
