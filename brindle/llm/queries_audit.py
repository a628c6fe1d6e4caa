"""Queries over whole tables: conversation trie, near-duplicate vectors and source divergence audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.llm.common import plain_table
from brindle.llm.divergence import audit
from brindle.llm.prefix_trie import rebuilt, trie
from brindle.llm.projection_counts import near_vectors
from brindle.llm.registry import query
TRIE_SQL = r"""
WITH b AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), b),
m AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT c.conv_id, 1 AS part, place, role, text FROM c JOIN m ON m.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 2, place, role, text FROM c JOIN m ON m.conv_id = c.conv_id AND place > h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, length(text) AS chars, string_agg(md5(role) || md5(text), '') OVER o AS prefix
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY part, place)),
q AS (SELECT conv_id, 0 AS depth, 0 AS chars, '' AS prefix FROM c UNION ALL SELECT * FROM p),
e AS (
  SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, prefix FROM q QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY prefix),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM q GROUP BY prefix, depth),
k AS (SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (
  SELECT left(prefix, 64 * up) AS prefix, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM w) GROUP BY ALL)
SELECT w.conv_id::BIGINT AS conv_id, w.depth::BIGINT AS depth, a.conv_id::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs,
       w.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN s USING (prefix) LEFT JOIN e USING (prefix) LEFT JOIN n a ON w.depth > 0 AND a.prefix = left(w.prefix, 64 * (w.depth - 1))
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    """Nodes of the trie of all conversations, rebuilt with the first turns of the first of their hundred."""
    return trie(rebuilt(plain_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))

VECTORS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query("op12_vector_links", VECTORS_SQL)
def op12_vector_links(spark, sf_dir):
    """Links and components of all vectors at a cosine of 0.95; tested against all pairs."""
    return near_vectors(plain_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT row, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (
  SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce(v.total, 0) AS lang_total, coalesce(b.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) b USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS held,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE held > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13_source_divergence(spark, sf_dir):
    """Each source against the other sources of its language, and the terms that it uses more than its language does."""
    docs = plain_table(spark, sf_dir, "documents").select("text", "lang", "source")
    return audit(docs).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
