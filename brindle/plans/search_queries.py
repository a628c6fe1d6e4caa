"""Hybrid search over documents and vectors: ranking, fusion, expansion, merging and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import pivot_join as P
from brindle.operators import search as S
from brindle.operators import text_index as X
from brindle.operators import vector_index as V
from brindle.plans.registry import query
from brindle.plans.text_queries import WINDOWS, chunks
from brindle.session import stored, table

# The queries of a search are the rows whose id is divisible by 100, against all rows.
DOT = "list_sum([a[i]::DOUBLE * b[i]::DOUBLE FOR i IN range(1, len(a) + 1)])"


def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item_id")
    return v.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), v


@query("dense_topk", f"""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.embedding AS a, e.embedding AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
s AS (SELECT query_id, item_id, {DOT} AS score FROM p)
SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank0 FROM s QUALIFY rank0 < 10""")  # fmt: skip
def dense_topk(spark, sf_dir):
    q, v = vectors(spark, sf_dir)
    return S.dense_search(q, v, 10).withColumn("score", F.round("score", 6))


@query("dense_topk_indexed")
def dense_topk_indexed(spark, sf_dir):
    """The nearest vectors by the inverted file, probed as far as its measured recall takes; tested against all pairs."""
    q, v = vectors(spark, sf_dir)
    index = V.calibrated(V.build_vector_index(v), v)
    return V.probed_search(q, index, 10).withColumn("score", F.round("score", 6))


@query("threshold_topk", f"""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.embedding AS a, e.embedding AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
s AS (SELECT query_id, item_id, {DOT} AS score FROM p)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank0 FROM s WHERE score > 0.5 QUALIFY rank0 < 10""")  # fmt: skip
def threshold_topk(spark, sf_dir):
    q, v = vectors(spark, sf_dir)
    return S.dense_search(q, v, 10, least=0.5).drop("score")


@query("semantic_cache_lookup", f"""
WITH p AS (SELECT y.vec_id, x.vec_id AS answered_by, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id),
s AS (SELECT vec_id, answered_by, {DOT} AS similarity FROM p)
SELECT vec_id, answered_by, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, answered_by) = 1""")  # fmt: skip
def semantic_cache_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("ts", F.col("vec_id")).withColumnRenamed("label", "scope")
    return P.cached_answers(e, 0.3).withColumn("similarity", F.round("similarity", 6))


@query("semantic_cache_hits", f"""
WITH p AS (SELECT y.vec_id, x.vec_id AS answered_by, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id),
s AS (SELECT vec_id, answered_by, {DOT} AS similarity FROM p)
SELECT vec_id, answered_by, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.96 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, answered_by) = 1""")  # fmt: skip
def semantic_cache_hits(spark, sf_dir):
    """All vectors as one scope, at the threshold of the shipped cache."""
    e = table(spark, sf_dir, "embeddings").withColumn("ts", F.col("vec_id")).withColumn("scope", F.lit("all"))
    return P.cached_answers(e).withColumn("similarity", F.round("similarity", 6))


TERMS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SANITISED = r"regexp_replace(coalesce(text, ''), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g')"
PHRASES = rf"""q AS (SELECT item_id AS query_id, ' ' || array_to_string({TERMS.format(SANITISED)}, ' ') || ' ' AS phrase FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string({TERMS.format('text')}, ' ') || ' ' AS body FROM documents)"""


def phrase_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_index(spark, sf_dir):
    """The positional index of the documents, written once in an application."""
    return X.index_of(spark, sf_dir, lambda: X.build_index(table(spark, sf_dir, "documents")))


@query("text_index_terms", f"""
WITH t AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, max(tf)::INT AS most FROM tf GROUP BY term""")  # fmt: skip
def text_index_terms(spark, sf_dir):
    """The dictionary of the stored index: documents that hold a term, and its greatest count."""
    return document_index(spark, sf_dir).dictionary()


@query("fts_phrase", f"WITH {PHRASES} SELECT query_id, doc_id FROM q JOIN d ON contains(body, phrase) WHERE length(phrase) > 2")
def fts_phrase(spark, sf_dir):
    return X.phrase_matches(phrase_queries(spark, sf_dir), document_index(spark, sf_dir))


@query("fts_like_fallback", "SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def fts_like_fallback(spark, sf_dir):
    return X.contains_matches(phrase_queries(spark, sf_dir), table(spark, sf_dir, "documents"), document_index(spark, sf_dir))


@query("query_sanitiser", r"""
SELECT item_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace('a AND "' || text || '"* (x) or^ y', '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '[*^"''()]', ' ', 'g'), '\s+', ' ', 'g')), '') AS q FROM benchmark""")
def query_sanitiser(spark, sf_dir):
    raw = F.concat(F.lit('a AND "'), "text", F.lit('"* (x) or^ y'))
    return table(spark, sf_dir, "benchmark").select("item_id", S.sanitised(raw).alias("q"))


SPARSE = rf"""
t AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * ln(1 + n / df)), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank0 FROM s QUALIFY rank0 < 10)"""


def sparse(spark, sf_dir, k=10):
    return X.best_by_weight(phrase_queries(spark, sf_dir), document_index(spark, sf_dir), k)


@query("sparse_topk", f"WITH {SPARSE} SELECT query_id, doc_id, round(score, 4) AS score, rank0 FROM sparse")
def sparse_topk(spark, sf_dir):
    return sparse(spark, sf_dir).withColumn("score", F.round("score", 4))


FUSED = f"""{SPARSE}, {PHRASES.replace('q AS', 'pq AS')},
phrase AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS rank0 FROM pq JOIN d ON contains(body, phrase) WHERE length(phrase) > 2 QUALIFY rank0 < 10),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (K + rank0)), 9) AS score FROM (SELECT query_id, doc_id, rank0 FROM sparse UNION ALL SELECT query_id, doc_id, rank0 FROM phrase) GROUP BY ALL)"""


def fusion(spark, sf_dir, k):
    phrase = S.top_k(X.phrase_matches(phrase_queries(spark, sf_dir), document_index(spark, sf_dir)), "query_id", 10, F.asc("doc_id"))
    return S.fused([sparse(spark, sf_dir), phrase], "query_id", ["doc_id"], k)


@query("rrf_fusion", f"WITH {FUSED.replace('K +', '61 +')} SELECT * FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion(spark, sf_dir, 61)


@query("rrf_fusion_inner", f"WITH {FUSED.replace('K +', '2 +')} SELECT * FROM fused")
def rrf_fusion_inner(spark, sf_dir):
    return fusion(spark, sf_dir, 2)


@query("recommended_files", f"""
WITH {SPARSE} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank0), 9) AS score, 1::BIGINT AS n_rows, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank0), 9) DESC, doc_id) - 1 AS rank0 FROM sparse WHERE rank0 < 40 QUALIFY rank0 < 10""")  # fmt: skip
def recommended_files(spark, sf_dir):
    return S.recommended_files(sparse(spark, sf_dir))


@query("prefiltered_files", f"WITH {SPARSE} SELECT query_id, doc_id FROM sparse WHERE rank0 < 8")
def prefiltered_files(spark, sf_dir):
    return S.prefiltered(sparse(spark, sf_dir), 20)


# Hits: every chunk with a figure in it, for one of ten queries.
HITS = f"{WINDOWS}, h AS (SELECT doc_id % 10 AS query_id, doc_id, k, 1.0::DOUBLE / (k + 1) AS score FROM w WHERE regexp_matches(document, '[0-9]'))"


def hits(spark, sf_dir):
    c = chunks(spark, sf_dir).drop("total_chunks")
    h = c.filter(F.col("document").rlike("[0-9]")).select((F.col("doc_id") % 10).alias("query_id"), "doc_id", "chunk_index", (1.0 / (F.col("chunk_index") + 1)).alias("score"))
    return h, c


EXPANDED = """e AS (SELECT query_id, doc_id, k + o AS k, max(CASE WHEN o = 0 THEN score ELSE score * 0.9 END) AS score FROM h, (SELECT unnest([-1, 0, 1]) AS o) GROUP BY ALL),
x AS (SELECT query_id, e.doc_id, e.k, e.score, w.document FROM e JOIN w ON e.doc_id = w.doc_id AND e.k = w.k)"""


@query("neighbour_expand", f"WITH {HITS}, {EXPANDED} SELECT query_id, doc_id, k::BIGINT AS chunk_index, round(score, 9) AS score, md5(document) AS hash FROM x")
def neighbour_expand(spark, sf_dir):
    x = S.expanded(*hits(spark, sf_dir))
    return x.select("query_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.round("score", 9).alias("score"), F.md5(F.col("document").cast("binary")).alias("hash"))


@query("adjacent_merge", f"""
WITH {HITS}, {EXPANDED}, r AS (SELECT *, sum(CASE WHEN p IS NULL OR k - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(k) OVER (PARTITION BY query_id, doc_id ORDER BY k) AS p FROM x))
SELECT query_id, doc_id, min(k)::BIGINT AS chunk_index, count(*) AS n_chunks, round(max(score), 9) AS score, md5(string_agg(document, chr(10) || chr(10) ORDER BY k)) AS hash FROM r GROUP BY query_id, doc_id, run""")  # fmt: skip
def adjacent_merge(spark, sf_dir):
    m = S.merged(S.expanded(*hits(spark, sf_dir)))
    return m.select("query_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "n_chunks", F.round("score", 9).alias("score"), F.md5(F.col("document").cast("binary")).alias("hash"))


@query("keyword_boost", f"""
WITH {SPARSE}, x AS (SELECT query_id, sp.doc_id, rank0, coalesce(regexp_matches(text, '[0-9]'), false) AS boosted FROM sparse sp JOIN documents dd ON dd.doc_id = sp.doc_id)
SELECT query_id, doc_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank0) - 1 AS place FROM x""")
def keyword_boost(spark, sf_dir):
    s = sparse(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.boosted_first(s, F.col("text").rlike("[0-9]")).select("query_id", "doc_id", "boosted", "place")


@query("rerank_fill", f"""
WITH {SPARSE}, o AS (SELECT query_id, rank0, 9 - rank0 AS place FROM sparse WHERE rank0 % 2 = 0), c AS (SELECT query_id, count(*) AS n FROM sparse GROUP BY 1), l AS (SELECT query_id, count(*) AS listed FROM o GROUP BY 1),
j AS (SELECT s.query_id, s.doc_id, s.score, s.rank0, place, n, listed, row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN n <= 2 THEN s.rank0 ELSE coalesce(place, 1::BIGINT << 40) END, s.rank0) - 1 AS new
      FROM sparse s LEFT JOIN o ON s.query_id = o.query_id AND s.rank0 = o.rank0 JOIN c ON c.query_id = s.query_id JOIN l ON l.query_id = s.query_id)
SELECT query_id, doc_id, new AS rank0, round(CASE WHEN n <= 2 THEN score WHEN place IS NULL THEN 0 ELSE 1 - new / listed END, 6) AS score FROM j WHERE new < 8 OR n <= 2""")  # fmt: skip
def rerank_fill(spark, sf_dir):
    s = sparse(spark, sf_dir)
    order = s.filter("rank0 % 2 = 0").select("query_id", "rank0", (9 - F.col("rank0")).alias("place"))
    return S.reranked(s, order, 8).select("query_id", "doc_id", "rank0", F.round("score", 6).alias("score"))


@query("rerank_snippet", r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, CASE WHEN length(text) <= 150 THEN text ELSE coalesce(substr(a[1], 1, 80) || ' ... ' || substr(list_filter(a[2:], lambda x: regexp_matches(x, '\d'))[1], 1, 70), substr(text, 1, 150)) END AS s FROM l)
SELECT doc_id, coalesce(nullif(trim(replace(s, chr(10), ' ')), ''), '(空)') AS snippet FROM s""")  # fmt: skip
def rerank_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", S.snippet(F.col("text")).alias("snippet"))


GRAMS = "list_distinct([substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)])"


@query("neighbour_similarity", f"""
WITH {WINDOWS}, p AS (SELECT doc_id, k, regexp_replace(document, '\\s+', '', 'g') AS t, regexp_replace(lag(document) OVER (PARTITION BY doc_id ORDER BY k), '\\s+', '', 'g') AS u FROM w),
g AS (SELECT doc_id, k, CASE WHEN length(t) < 3 THEN [t] ELSE {GRAMS.format('t')} END AS a, CASE WHEN length(u) < 3 THEN [u] ELSE {GRAMS.format('u')} END AS b FROM p WHERE u IS NOT NULL)
SELECT doc_id, k::BIGINT AS chunk_index, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1), 6) AS similarity FROM g""")  # fmt: skip
def neighbour_similarity(spark, sf_dir):
    """Trigram similarity of each chunk and the one before it."""
    before = F.lag("document").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    c = chunks(spark, sf_dir).withColumn("before", before).filter("before is not null")
    c = c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), S.grams(F.col("document")).alias("a"), S.grams(F.col("before")).alias("b"))
    return c.select("doc_id", "chunk_index", F.round(S.overlap(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("two_corpus_search", f"""
WITH {SPARSE} SELECT query_id, doc_id, corpus FROM (SELECT query_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'case' ELSE 'public' END AS corpus, rank0 FROM sparse)
QUALIFY row_number() OVER (PARTITION BY query_id, corpus ORDER BY rank0) <= 6""")  # fmt: skip
def two_corpus_search(spark, sf_dir):
    mine = table(spark, sf_dir, "labels").select("doc_id", F.lit("case").alias("mine")).distinct()
    s = sparse(spark, sf_dir).join(mine, "doc_id", "left").withColumn("corpus", F.coalesce("mine", F.lit("public")))
    w = Window.partitionBy("query_id", "corpus").orderBy("rank0")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 6").select("query_id", "doc_id", "corpus")


@query("first_seen_content", "SELECT md5(trim(text)) AS hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def first_seen_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.md5(F.trim("text").cast("binary")).alias("hash"), "doc_id")
    w = Window.partitionBy("hash").orderBy("doc_id")
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").select("hash", "doc_id")


@query("context_by_priority", f"""
WITH {WINDOWS}, p AS (SELECT doc_id AS query_id, k AS part_no, CASE k % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph_qa' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'sql' ELSE 'table' END ELSE 'cross_filter' END AS kind, length(document) AS n FROM w),
o AS (SELECT *, CASE kind WHEN 'sql' THEN 0 WHEN 'cross_filter' THEN 1 WHEN 'graph_qa' THEN 2 WHEN 'table' THEN 3 ELSE 4 END AS pr, max((kind = 'sql')::INT) OVER (PARTITION BY query_id) AS has FROM p),
f AS (SELECT *, sum(n + 2) OVER (PARTITION BY query_id ORDER BY pr, part_no ROWS UNBOUNDED PRECEDING) AS used FROM o WHERE has = 0 OR kind IN ('sql', 'cross_filter', 'graph_qa'))
SELECT query_id, part_no::BIGINT AS part_no, kind, used::BIGINT AS used FROM f WHERE used <= 2500""")  # fmt: skip
def context_by_priority(spark, sf_dir):
    c = chunks(spark, sf_dir)
    m = F.col("chunk_index") % 4
    kind = F.when(m == 0, "vector").when(m == 1, "graph_qa").when(m == 2, F.when(F.col("doc_id") % 2 == 0, "sql").otherwise("table")).otherwise("cross_filter")
    parts = c.select(F.col("doc_id").alias("query_id"), F.col("chunk_index").cast("bigint").alias("part_no"), kind.alias("kind"), "document")
    return S.in_priority(parts, {"sql": 0, "cross_filter": 1, "graph_qa": 2, "table": 3}, limit=2500).select("query_id", "part_no", "kind", "used")


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    """Passages for every benchmark text by the whole chain. Vectors stand in for an encoder's: a chunk has that of its
    document's id, a question that of its own; the chain is tested against its definition on a small fixture."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = chunks(spark, sf_dir).drop("total_chunks").join(v, "doc_id", "left")
    head = F.col("chunk_index") < 3
    s = c.filter(head).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "document"))).alias("a"))
    s = s.filter(F.size("a") > 1).select("doc_id", F.lit(0).alias("chunk_index"), F.array_join(F.transform("a", lambda x: x["document"]), "\n\n").substr(1, 1500).alias("document")).join(v, "doc_id", "left")
    q = phrase_queries(spark, sf_dir).join(v.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    found = S.hybrid_search(q, stored(c), s, k=5)
    return found.select("query_id", "rank0", "doc_id", "chunk_index", F.round("score", 9).alias("score"), F.length("document").alias("n_chars"))


@query("vector_map")
def vector_map(spark, sf_dir):
    """Principal components of the vectors; signs are arbitrary, tested by the variance they hold."""
    from brindle.operators.models import projected

    d = projected(table(spark, sf_dir, "embeddings"))
    return d.select("vec_id", F.round(F.get("xy", F.lit(0)), 6).alias("x"), F.round(F.get("xy", F.lit(1)), 6).alias("y"))


@query("vector_clusters")
def vector_clusters(spark, sf_dir):
    """Components of a Gaussian mixture, 1 to 9 as in the reference, chosen by BIC; an iterative fit."""
    from brindle.operators.models import mixture

    return mixture(table(spark, sf_dir, "embeddings"), 9).select("vec_id", F.col("cluster").cast("bigint").alias("cluster"))


@query("table_search", f"""
WITH {FUSED.replace('K +', '2 +')} SELECT query_id, doc_id AS table_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank0
FROM fused WHERE score >= 0.35 AND doc_id NOT IN (1, 2, 3) QUALIFY rank0 < 2""")  # fmt: skip
def table_search(spark, sf_dir):
    f = fusion(spark, sf_dir, 2).withColumnRenamed("doc_id", "table_id")
    return S.table_search(f, 2, gone=[1, 2, 3]).withColumn("score", F.round("score", 6))
