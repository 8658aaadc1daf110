"""SQL (DuckDB) that gives the rows of those queries that SQL can express, on the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hits AS (
  SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS r FROM documents
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.node
)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE node = documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""

NEAREST = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x, v.x) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)
), e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: crc32 of an id as text, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

TRIE = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)
), s AS (
  SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = base AND i <= h
  UNION ALL
  SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h
), p AS (
  SELECT conv_id, count(*) OVER own AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER own AS key, length(text) AS chars
  FROM s WINDOW own AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), nodes AS (
  SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own FROM p GROUP BY key
), below AS (
  SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes
), children AS (
  SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT left(b.key, 64 * up) AS key, CAST(sum(own) AS BIGINT) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM below b LEFT JOIN children c ON b.key = c.key GROUP BY 1
), ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved AS saved_tokens, coalesce(ends.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (key) LEFT JOIN children USING (key) LEFT JOIN ends USING (key)
  LEFT JOIN nodes up ON n.depth > 0 AND up.key = left(n.key, 64 * (n.depth - 1))
"""

COLLOCATIONS = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS sizes(m))
), f AS (
  SELECT lang, m, p, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, p, a, string_split(p, ' ') AS w FROM f WHERE m > 1 AND a >= 100
), cuts AS (
  SELECT lang, m, p, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), scores AS (
  SELECT c.lang, c.m, c.p, c.a, k, x.a AS l, y.a AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = head JOIN f y ON y.lang = c.lang AND y.p = tail JOIN n ON n.lang = c.lang
), one AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(w[1 : m - 1], ' ') AS p, a FROM c WHERE m > 2 UNION SELECT lang, array_to_string(w[2 : m], ' '), a FROM c WHERE m > 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM one ANTI JOIN held USING (lang, p, a) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op4_nearest": NEAREST,
    "op8_ngram_jaccard_join": JACCARD,
    "op10_chat": CHAT,
    "op11_prefix_trie": TRIE,
    "op13_collocations": COLLOCATIONS,
}
