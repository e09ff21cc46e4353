"""DuckDB SQL for the queries of this package that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")

OP1 = f"""
WITH l AS (
  SELECT doc_id, pos, line, {LINE_KEY} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
d AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT l.doc_id, l.pos, l.line, (d.k IS NOT NULL AND d.owner <> l.doc_id) AS gone
  FROM l LEFT JOIN d ON l.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP4 = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

# Base-32 digits are cut from the bits of the hash, five at a time.
OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p),
b AS (SELECT DISTINCT h, list_transform(range(32), lambda i: (
        ('0x' || substr(h || '0', i * 5 // 4 + 1, 2))::INTEGER >> (3 - (i * 5) % 4)) % 32) AS d FROM p)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       array_to_string(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g JOIN b USING (h)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS ws, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN g USING (doc_id)),
h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (
  SELECT part, n, good, toxic, fails, filter_order, step, x, contains(fails, x) AS bad,
         translate(earlier, fails, '') <> earlier AS gone
  FROM h, s),
r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE bad AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""

OP12 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT r.doc_id, CASE WHEN e.x = r.other THEN e.y ELSE e.x END FROM r JOIN e ON e.x = r.other OR e.y = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

# CRC-32 a byte at a time, eight shifts a byte; a conversation's path is its turns' hashes in a row.
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"

OP11 = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len({_WORDS.format("coalesce(text, '')")}) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: {_CRC_BYTE}), 4294967295) % 4 AS h
  FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
r AS (
  SELECT c.conv_id, 0 AS own, o.pos, o.k, o.w FROM c JOIN o ON o.conv_id = c.head AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.k, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
d AS (
  SELECT conv_id, k, w, row_number() OVER s AS depth, string_agg(k, '') OVER s AS path
  FROM r WINDOW s AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, w, path FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT conv_id, max(depth) AS turns FROM m GROUP BY conv_id),
n AS (
  SELECT path, depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM m JOIN z USING (conv_id) GROUP BY path, depth),
k AS (SELECT left(path, 64 * (depth - 1)::INTEGER) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT left(path, 64 * a::INTEGER) AS path, n_convs, w, n_children FROM (SELECT *, unnest(range(depth + 1)) AS a FROM b)),
s AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM u GROUP BY path)
SELECT b.conv_id, b.depth, p.conv_id AS parent_conv_id, b.n_convs, b.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, b.ends_sha256
FROM b JOIN s USING (path) LEFT JOIN b p ON b.depth > 0 AND p.path = left(b.path, 64 * (b.depth - 1)::INTEGER)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op3_warc": OP3,
    "op4_exact_dedup": OP4,
    "op6_exact_topk": OP6,
    "op11_prefix_trie": OP11,
    "op12_jaccard_join": OP12,
    "op13_filter_audit": OP13,
}
