"""SQL twins of the text queries that SQL can express. Words are runs without space and \\x09-\\x0D."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(a[p : p + least(len(a), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 2, 1) + 1)) AS p FROM w WHERE len(a) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""

OP7 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS a FROM documents
), k AS (
  SELECT doc_id, p, array_to_string(a[p : p + 19], ' ') AS g
  FROM (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS p FROM w WHERE len(a) >= 20)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p
  FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM k) WHERE nth > 1
), gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN a ELSE [x for x, i in a if NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP9 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents
), k AS (
  SELECT doc_id, p, a[p : p + 2] AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS p FROM l WHERE len(a) >= 3)
  WHERE regexp_matches(array_to_string(a[p : p + 2], ' '), '[^\x20\x09-\x0D]')
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p
  FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM k) WHERE nth > 1
), gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(gone.n, 0)::BIGINT AS n_removed,
       CASE WHEN ps IS NULL THEN text ELSE array_to_string([x for x, i in a if NOT list_contains(ps, i)], chr(10)) END AS text
FROM l LEFT JOIN gone USING (doc_id)
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, max(k) AS n FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda crc, byte: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT
         ), 4294967295::BIGINT) % 9 AS h FROM n
), c AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN n b ON b.conv_id = h.base
), r AS (
  SELECT c.conv_id, k AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= c.h
  UNION ALL SELECT c.conv_id, m + k - c.h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > c.h
), a AS (
  SELECT c.conv_id, coalesce(s, []) AS s, coalesce(b, []) AS b FROM c LEFT JOIN (
    SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY d) AS s, list(octet_length(encode(text)) ORDER BY d) AS b FROM r GROUP BY conv_id
  ) USING (conv_id)
), p AS (SELECT conv_id, d, array_to_string(list_slice(s, 1, d), ',') AS s, coalesce(b[d], 0) AS bytes, len(s) AS l FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM a)
), m AS (
  SELECT conv_id, d, l, bytes, min(conv_id) OVER (PARTITION BY d, s) AS node, count(*) OVER (PARTITION BY d, s) AS n_convs FROM p
), v AS (
  SELECT DISTINCT m.node, m.d, m.n_convs, (m.n_convs - 1) * m.bytes AS saving, up.node AS parent FROM m LEFT JOIN m up ON up.conv_id = m.node AND up.d = m.d - 1
), w AS (
  SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS n FROM v GROUP BY ALL) k ON k.parent = v.node AND k.d = v.d
), under AS (
  SELECT m.node, m.d, count(*) FILTER (w.n_children = 0) AS leaves, sum(w.saving) AS saved FROM w JOIN m ON m.conv_id = w.node AND m.d <= w.d GROUP BY ALL
), ends AS (SELECT node, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m WHERE d = l GROUP BY ALL)
SELECT w.node AS conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN under USING (node, d) LEFT JOIN ends USING (node, d)
"""

ORACLE = {
    "op1_ngram_jaccard_join": OP1,
    "op7_url_filters": OP7,
    "op8_substring_dedup": OP8,
    "op9_line_dedup": OP9,
    "op12_conversation_trie": OP12,
}
