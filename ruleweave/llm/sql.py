"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: CRC32 from its table of 256 entries, made by its polynomial; bytes come as hex digits.
OP1 = """
WITH RECURSIVE
t(b, c, k) AS (
  SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, CASE WHEN size = 16 THEN 0 ELSE xor(4294967295, list_reduce(
      list_transform(range(size - 16), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), CAST(4294967295 AS BIGINT))) END AS text_crc32
  FROM d, tab),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM c),
s AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS DOUBLE) AS grown_shard
FROM s
"""

OP4 = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win
  FROM (SELECT doc_id, l, unnest(range(1, CAST(len(l) AS BIGINT) - 1)) AS i FROM l WHERE len(l) >= 3)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k
  FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l),
kept AS (
  SELECT line.doc_id, string_agg(line, chr(10) ORDER BY line.pos) AS kept
  FROM line ANTI JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos GROUP BY line.doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, kind, k, unnest(list_zip(
      regexp_extract_all(t, p), regexp_extract_all(t, p, g))) AS z, p, g, least_n, generate_subscripts(regexp_extract_all(t, p), 1) AS i
  FROM d, (VALUES
    ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    ('access', 1, '(AKIA[A-Z0-9]+)', 1, 20),
    ('hex', 2, '([0-9a-f]{24,})', 1, 24)) AS v(kind, k, p, g, least_n)),
s AS (
  SELECT *, len(array_to_string(list_slice(regexp_split_to_array(t, p), 1, i), ''))
    + len(array_to_string(list_slice(regexp_extract_all(t, p), 1, i - 1), '')) AS start
  FROM m WHERE len(z[2]) >= least_n),
a AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || (start + len(z[1])), ',' ORDER BY start, k) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
c AS (
  SELECT t.doc_id, t.pos, t.word, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS last_start
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.pos),
k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM c WHERE last_start IS NULL OR last_start + 34 < pos GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.low) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

OP9 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL = {"op1_shard": OP1, "op9_neighbours": OP9, "op6_jaccard": OP6, "op10_substrings": OP10, "op2_secrets": OP2, "op4_line_dedup": OP4}
