"""The corpus queries as DuckDB SQL, where SQL can say them."""

ORACLES = {
    # Every pair of a label, then the smallest id that links reach, by recursion.
    "op1_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages
), cleaned AS (
  SELECT page_id, host, path,
         list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS args,
         try_cast(regexp_extract(path, '/([0-9]{1,18})(\.html|/)?$', 1) AS BIGINT) AS document
  FROM parts
), named AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '')
      || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical
  FROM cleaned
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE canonical IS NOT NULL AND document IN (SELECT doc_id FROM labels WHERE toxic = 1)
), rules(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path, page_id FROM named) n JOIN rules r
    ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)
  GROUP BY ALL
)
SELECT n.page_id, n.host, n.path, b.rule,
       coalesce(b.action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN best b ON n.page_id = b.page_id AND n.host = b.host AND n.path = b.path
LEFT JOIN listed l ON n.canonical = l.canonical
""",
    # Buckets, two multinomials, integer weights and the threshold, as the operator has them.
    "op13_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
h AS (SELECT r, i, word, ('0x' || left(md5(word), 8))::BIGINT AS h FROM tok),
grams AS (
  SELECT r, h % 65536 AS g FROM h
  UNION ALL
  SELECT r, (h * 1000003 + next + 1) % 65536 FROM (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS next FROM h) WHERE next IS NOT NULL
),
trusted AS (
  SELECT doc_id, left(md5(doc_id::VARCHAR), 1) < '8' AS held FROM labels WHERE doc_id IS NOT NULL
  GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 1)) = 0
),
role AS (SELECT d.r, t.held FROM d JOIN trusted t USING (doc_id)),
raw AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE r IN (SELECT r FROM role WHERE NOT held)) AS t FROM grams GROUP BY g),
totals AS (SELECT sum(n)::DOUBLE AS n, sum(t)::DOUBLE AS t FROM raw),
weight AS (
  SELECT g, CASE WHEN totals.t = 0 THEN 0 ELSE
    round(1000000 * (ln((raw.t + 1) / (totals.t + 65536)) - ln((raw.n + 1) / (totals.n + 65536)))) END::BIGINT AS m
  FROM raw, totals
),
score AS (SELECT r, floor(sum(m) / count(*)::DOUBLE)::BIGINT AS llr_micro FROM grams JOIN weight USING (g) GROUP BY r),
windows AS (
  SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM tok
),
twice AS (SELECT r, win FROM windows WHERE len(win) = 8 GROUP BY r, win HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM windows JOIN twice USING (r, win)) GROUP BY r
),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
base AS (
  SELECT w.r, w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(llr_micro, 0) AS llr_micro
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN score USING (r)
),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
held AS (
  SELECT place, sum(n) OVER (ORDER BY place) - n AS below, sum(n) OVER () AS total
  FROM (SELECT floor(llr_micro / 1000)::BIGINT AS place, count(*) AS n FROM failed
        WHERE NOT base_failed AND r IN (SELECT r FROM role WHERE held) GROUP BY 1)
),
least AS (SELECT max(place) AS place FROM held WHERE below <= 0.001::DOUBLE * total)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (least.place IS NULL OR floor(llr_micro / 1000) >= least.place) AS kept, llr_micro
FROM failed, least
""",
    # Every prefix of every rebuilt conversation; crc32 by its table of 256 remainders.
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
), turns AS (
  SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32), strlen(text)) AS ts
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), crc AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a // 256, t.t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) % 9 AS h
  FROM turns, t
), built AS (
  SELECT c.conv_id AS c, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS p
  FROM crc c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5
), pre AS (
  SELECT c, len(p) AS n, d, p[1:d] AS k FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM built)
), node AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM pre GROUP BY k, d
), kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k, d)),
below AS (
  SELECT k[1:a] AS k, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d].x) END)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY 1, 2
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_node f JOIN below USING (k, d) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
""",
}
