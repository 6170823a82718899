"""DuckDB SQL for the operators that SQL can express."""

OP1 = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(10) || text ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM w)),
k AS (SELECT w.* FROM w ANTI JOIN p ON w.turns = p.turns)
SELECT k.conv_id, t.turn // 256 AS part, CAST(len(k.turns) AS BIGINT) AS n_turns, k.n_copies,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.turn, t.role, t.text) AS rendered
FROM k JOIN t USING (conv_id) GROUP BY ALL
"""

OP2 = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.])(ads-track[.]example[.]com|spam-farm[.]example[.]org|casino-win[.]example[.]net|adult-x[.]example[.]com|cheap-pills[.]example[.]net|free-bets[.]example[.]net)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE r <= 3
"""

OP12 = """
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS r, doc_id, source, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS n, text AS t,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
m AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS altered, xor(crc, 4294967295) % 5 = 0 AS tampered
  FROM (SELECT *, list_aggregate(list_transform([a, b, c, n], lambda x: coalesce(strlen(x) || ':' || x, '-')), 'string_agg', '') AS head,
               list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(a, ''), lambda x: [ascii(x)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
                 lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 1) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END) AS crc FROM c)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM m),
w AS (
  SELECT 0 AS level, source, i, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT level + 1, source, i // 16, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 15) // 16 FROM w WHERE n > 1 GROUP BY level, source, i // 16),
s AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM w WHERE n = 1),
u AS (
  SELECT 0 AS level, i, subroot AS d, n FROM s
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY level, i // 16),
e AS (
  SELECT r, 0 AS tree, q.level, string_agg(d, '' ORDER BY w.i) FILTER (w.i < o) AS before, string_agg(d, '' ORDER BY w.i) FILTER (w.i > o) AS after
  FROM (SELECT l.r, l.source, v.level, l.i // CAST(power(16, v.level) AS BIGINT) AS o FROM l JOIN (SELECT DISTINCT source, level FROM w WHERE n > 1) v ON l.source IS NOT DISTINCT FROM v.source) q
  JOIN w ON q.source IS NOT DISTINCT FROM w.source AND q.level = w.level AND q.o // 16 = w.i // 16 GROUP BY ALL
  UNION ALL
  SELECT r, 1, q.level, string_agg(d, '' ORDER BY u.i) FILTER (u.i < o), string_agg(d, '' ORDER BY u.i) FILTER (u.i > o)
  FROM (SELECT l.r, v.level, s.i // CAST(power(16, v.level) AS BIGINT) AS o FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source, (SELECT DISTINCT level FROM u WHERE n > 1) v) q
  JOIN u ON q.level = u.level AND q.o // 16 = u.i // 16 GROUP BY ALL),
p AS (SELECT r, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY tree, level) AS proof, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY tree, level) AS steps FROM e GROUP BY r),
f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN tampered THEN altered ELSE leaf END], coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN p ON l.r = p.r)
SELECT *, folded_root = root AS verified FROM f
"""

SQL = {"op1_chat_formatting": OP1, "op2_url_filters": OP2, "op4_exact_top_k": OP4, "op11_hard_negatives": OP11, "op12_merkle_manifest": OP12}
