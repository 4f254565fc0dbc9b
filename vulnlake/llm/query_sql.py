"""SQL of the operators on vectors and conversations."""

from __future__ import annotations

OP12_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS j, q FROM v ORDER BY j LIMIT 40
)""" + "".join(rf""", a{r} AS MATERIALIZED (
  SELECT vec_id, q, j, d FROM (
    SELECT v.vec_id, v.q, c.j, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS d,
           row_number() OVER (PARTITION BY v.vec_id ORDER BY list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q), c.j) AS nth
    FROM v, c{r} c
  ) WHERE nth = 1
)""" + (rf""", m{r} AS (
  SELECT j, i, floor(sum(x) / count(*)) AS x FROM (SELECT j, unnest(range(64)) AS i, unnest(q) AS x FROM a{r}) GROUP BY j, i
), c{r + 1} AS MATERIALIZED (
  SELECT j, list(x ORDER BY i) AS q FROM m{r} GROUP BY j UNION ALL SELECT j, q FROM c{r} WHERE j NOT IN (SELECT j FROM a{r})
)""" if r < 5 else "") for r in range(6)) + r"""
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a5 a JOIN c5 c ON a.j = c.j
"""

OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, n, c - c % 5 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), i AS (
  SELECT k.*, least(k.h, coalesce(b.n, 0)) AS taken FROM k LEFT JOIN k b ON b.c = k.base
), r AS MATERIALIZED (
  SELECT i.c, t.at AS d, t.role, t.text FROM i JOIN t ON t.c = i.base WHERE t.at <= i.h
  UNION ALL SELECT i.c, t.at - i.h + i.taken, t.role, t.text FROM i JOIN t ON t.c = i.c WHERE t.at > i.h
), p AS MATERIALIZED (
  SELECT c, d, text, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS key
  FROM (SELECT *, sha256(role) || sha256(text) AS x FROM r)
  UNION ALL SELECT c, 0, '', '' FROM k
), ends AS (
  SELECT c, max(d) AS total FROM p GROUP BY c
), node AS MATERIALIZED (
  SELECT d, sha256(key) AS key, sha256(substring(key, 1, length(key) - 128)) AS up, min(p.c) AS conv_id, count(*) AS n, min(octet_length(encode(text))) AS size,
         sha256(coalesce(string_agg(CASE WHEN d = total THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM p JOIN ends e ON p.c = e.c GROUP BY d, key
), kids AS MATERIALIZED (
  SELECT d - 1 AS d, up, count(*) AS n FROM node WHERE d > 0 GROUP BY d, up
), full_node AS MATERIALIZED (
  SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.d = kids.d AND node.key = kids.up
), below AS (
  SELECT a.d, sha256(a.key) AS key, sum((w.n - 1) * w.size) AS saved, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM full_node w JOIN p q ON q.c = w.conv_id AND q.d = w.d JOIN p a ON a.c = q.c AND a.d <= q.d GROUP BY a.d, a.key
)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN u.conv_id END AS parent_conv_id, f.n AS n_convs, f.n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b ON b.d = f.d AND b.key = f.key LEFT JOIN node u ON u.d = f.d - 1 AND u.key = f.up
"""
