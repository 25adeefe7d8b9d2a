"""SQL for a second engine, where SQL can say what an operator does."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows of 20 words that also start earlier; the words they cover go.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p.p, array_to_string(w[p.p:p.p + 19], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p) p WHERE len(w) >= 20),
firsts AS (SELECT g, min((doc_id, p)) AS f, count(*) AS n FROM win GROUP BY g HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM win JOIN firsts USING (g) WHERE (doc_id, p) <> f),
gone AS (SELECT DISTINCT doc_id, q.q AS p FROM later, LATERAL (SELECT unnest(range(p, p + 20)) AS q) q),
w AS (SELECT doc_id, p.p, w[p.p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) p),
k AS (SELECT w.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY w.p) AS kept
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: Links by exact counts of shared 3-word shingles; classes by closure over links, one document standing for each set.
NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS sh FROM d),
node AS (SELECT sh, min(doc_id) AS node, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS g FROM node),
pair AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.node < b.node
  AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 90 * (na + nb - k)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, r) AS (SELECT node, node FROM node UNION SELECT way.b, reach.r FROM reach JOIN way ON way.a = reach.node),
root AS (SELECT node, min(r) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(root.root, s.doc_id) AS component_id
FROM s LEFT JOIN node ON node.sh = s.sh LEFT JOIN root USING (node)
"""

#: Integer inner products of all wanted rows with all others.
EXACT_TOPK = """
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.own, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.own <> b.own WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: CRC-32 bit by bit over the digits of an identifier.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda a, e: CASE WHEN xor(a, e) % 2 = 1 THEN xor(xor(a, e) // 2, CAST(3988292384 AS UBIGINT)) ELSE xor(a, e) // 2 END, CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"""

#: Every prefix as a list of turns; sums over subtrees by giving each node's own to all of its prefixes.
CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, CAST({_CRC.format(c="c")} % 4 AS BIGINT) AS h, c - c % 20 AS base, list({{'r': r, 'x': x}} ORDER BY i) AS own FROM t GROUP BY c),
b AS (SELECT k.c, list_concat(CASE WHEN z.c IS NULL OR k.h = 0 THEN [] ELSE z.own[1:k.h] END, k.own[k.h + 1:]) AS s FROM k LEFT JOIN k z ON z.c = k.base),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b),
m AS (SELECT c, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS key, d = len(s) AS last,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].x, '[^\x20\x09-\x0D]+')) END AS w FROM p),
node AS (SELECT key, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS e FROM m GROUP BY key, d),
up AS (SELECT key, d, CASE WHEN d = 1 THEN [] ELSE key[1:d - 1] END AS above FROM node WHERE d > 0),
kid AS (SELECT above AS key, d - 1 AS d, count(*) AS n_children FROM up GROUP BY 1, 2),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid ON kid.key = node.key AND kid.d = node.d),
each AS (SELECT *, unnest(range(0, d + 1)) AS up_to FROM own),
roll AS (SELECT CASE WHEN up_to = 0 THEN [] ELSE key[1:up_to] END AS key, up_to AS d, sum((n - 1) * w) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM each GROUP BY 1, 2)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children,
  CAST(roll.leaves AS BIGINT) AS n_leaves, CAST(roll.saved AS BIGINT) AS saved_tokens, sha256(o.e) AS ends_sha256
FROM own o JOIN roll ON roll.key = o.key AND roll.d = o.d LEFT JOIN up ON up.key = o.key AND up.d = o.d LEFT JOIN node a ON a.key = up.above AND a.d = o.d - 1
"""
