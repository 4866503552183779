"""SQL for the corpus queries that SQL can express, on DuckDB."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {}

SQL["op2_lines"] = f"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
sets AS (SELECT doc_id, line, list_distinct(regexp_extract_all(line_text, {WORD})) AS words FROM split),
word AS (SELECT doc_id, line, len(words) AS n, unnest(words) AS w FROM sets),
freq AS (SELECT w, count(*) AS f FROM word GROUP BY w),
ranked AS (SELECT doc_id, line, n, w, row_number() OVER (PARTITION BY doc_id, line ORDER BY f, w) AS r FROM word JOIN freq USING (w)),
prefix AS (SELECT * FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.doc_id, a.line, b.doc_id AS doc_b, b.line AS line_b FROM prefix a JOIN prefix b ON a.w = b.w
  AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.line < a.line) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
both_sets AS (SELECT p.doc_id, p.line, len(list_intersect(x.words, y.words)) AS shared, len(x.words) + len(y.words) AS total
  FROM pairs p JOIN sets x ON x.doc_id = p.doc_id AND x.line = p.line JOIN sets y ON y.doc_id = p.doc_b AND y.line = p.line_b)
SELECT DISTINCT doc_id, line FROM both_sets WHERE 9 * shared >= 4 * total"""

SQL["op3_substrings"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
word AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM docs),
spans AS (SELECT r, i, n, w, CASE WHEN i <= n - 34 THEN md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM word),
seen AS (SELECT h FROM spans WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT r, i, w, max(CASE WHEN s.h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM spans LEFT JOIN seen s USING (h)),
per AS (SELECT r, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN per USING (r)"""

SQL["op5_neighbours"] = """
WITH fine AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

SQL["op6_chat"] = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos FROM turns),
rolled AS (SELECT *, md5(string_agg(coalesce('+' || role, '-') || chr(31) || coalesce('+' || text, '-') || chr(30), '')
  OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
kept AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies FROM rolled WHERE pos = n AND h NOT IN (SELECT h FROM rolled WHERE pos < n) GROUP BY h, n)
SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS part, n_turns, copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM kept JOIN placed USING (conv_id) GROUP BY ALL"""

SQL["op11_divergence"] = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
spread AS (SELECT lang, source, unnest(terms) AS term FROM docs),
held AS (SELECT lang, source, unnest(list_distinct(terms)) AS term FROM docs),
kept AS (SELECT lang, term FROM held GROUP BY ALL HAVING count(*) >= 3),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM spread JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p
  FROM totals g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (c.n + 1) // (t.total + v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) c
  JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) t USING (lang) JOIN v USING (lang)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair_sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT s.lang, s.source, s.term AS item, CAST((s.p - l.q) * (s.p - l.q) // l.q AS BIGINT) AS value FROM shares s JOIN langs l USING (lang, term) WHERE s.n > 0 AND s.p > l.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

SQL["op13_prefix_trie"] = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n FROM turns GROUP BY conv_id),
bits AS (SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1))) AS bits FROM sizes),
codes AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, bits), lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295) % 4 AS h FROM bits),
convs AS (SELECT s.conv_id, s.base, h, least(h, coalesce(b.n, 0)) AS taken FROM sizes s JOIN codes USING (conv_id) LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (SELECT c.conv_id, pos AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT conv_id, pos - h + taken, role, text FROM convs JOIN turns USING (conv_id) WHERE pos > h),
paths AS (SELECT conv_id, depth, len(regexp_extract_all(text, {WORD})) AS words,
    md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY depth, k),
steps AS (SELECT DISTINCT p.depth, p.k, q.k AS parent FROM paths p JOIN paths q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS n FROM steps GROUP BY ALL),
wide AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN kids c USING (depth, k)),
below AS (SELECT p.depth, p.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * v.words) AS saved
  FROM wide v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.depth, p.k),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT depth, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM paths JOIN last USING (conv_id, depth) GROUP BY depth, k)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM wide w JOIN below USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN steps s USING (depth, k) LEFT JOIN nodes q ON q.depth = w.depth - 1 AND q.k = s.parent"""
