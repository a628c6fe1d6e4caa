"""Rules of cells, lines, names, answers and jobs over given tables.

Where a rule is about words that the tables don't hold, a row's own values stand between them (as a cell, a mark or a line), so
each result still follows the table; the SQL beside it computes the rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import nlp as N
from brindle.functions import text as X
from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.operators import search as S
from brindle.plans.graph_queries import EDGES, edges
from brindle.plans.registry import query
from brindle.plans.text_queries import WINDOWS, chunks
from brindle.session import table
from brindle.sources import readers
from brindle.streaming import monitors as M


def text_of(name: str):
    return F.col(name).cast("string")


@query("row_kinds", r"""
WITH c AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ['合计', o_custkey::VARCHAR] WHEN 1 THEN ['--', '', ':-:'] WHEN 2 THEN ['（' || o_custkey || '）', '(2)'] WHEN 3 THEN ['注：' || o_custkey, 'x'] WHEN 4 THEN [' ', NULL] ELSE [o_orderstatus, o_custkey::VARCHAR] END AS cells FROM orders),
f AS (SELECT k, list_filter(list_transform(cells, lambda x: trim(coalesce(x, ''))), lambda x: x <> '') AS f FROM c)
SELECT k AS o_orderkey, CASE WHEN len(f) = 0 THEN 'empty' WHEN len(list_filter(f, lambda x: NOT regexp_full_match(x, '[-:]*'))) = 0 THEN 'rule' WHEN len(list_filter(f, lambda x: NOT regexp_full_match(x, '[（(]\d+[）)]'))) = 0 THEN 'index'
  WHEN regexp_matches(f[1], '^(说明|注[：:])') THEN 'note' WHEN f[1] IN ('合计', '总计', '小计') THEN 'total' ELSE 'data' END AS kind FROM f""")  # fmt: skip
def row_kinds(spark, sf_dir):
    """What each row of a sheet of orders is: every sixth a total, a rule, an index, a note or empty."""
    m, c = F.col("o_orderkey") % 6, text_of("o_custkey")
    cells = (
        F.when(m == 0, F.array(F.lit("合计"), c)).when(m == 1, F.array(F.lit("--"), F.lit(""), F.lit(":-:"))).when(m == 2, F.array(F.concat(F.lit("（"), c, F.lit("）")), F.lit("(2)")))
        .when(m == 3, F.array(F.concat(F.lit("注："), c), F.lit("x"))).when(m == 4, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.col("o_orderstatus"), c))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", R.row_class(cells).alias("kind"))


STATES = "CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'too_large' WHEN 2 THEN 'empty_text' WHEN 3 THEN NULL ELSE event_type END"


@query("files_counted", f"""
WITH s AS (SELECT {STATES} AS status FROM events)
SELECT status, count(*) AS n, CASE status WHEN 'empty_text' THEN '未提取到文本 (可能是纯图扫描件)' WHEN 'unsupported_format' THEN '不支持的格式' WHEN 'too_large' THEN '文件体积过大' WHEN 'failed' THEN '解析过程失败' END AS reason FROM s GROUP BY status""")  # fmt: skip
def files_counted(spark, sf_dir):
    """Jobs that count as files, by state, and those that don't with the reason."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(STATES).alias("status"))
    kept = R.counted(e).groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(None).cast("string").alias("reason"), "n")
    return kept.unionByName(R.excluded(e))


@query("sheet_heads", """
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 15""")
def sheet_heads(spark, sf_dir):
    """The first fifteen orders of each customer stand for the customer's sheet."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    return R.head_rows(d, "o_custkey", "o_orderkey")


@query("given_sparse_weights", """
WITH t AS (SELECT user_id AS key, event_id % 50 AS token, round(value, 2) AS weight FROM events),
v AS (SELECT key, token, max(weight) AS weight FROM t WHERE weight > 0 AND token NOT IN (0, 1, 2) GROUP BY ALL),
a AS (SELECT * FROM v UNION ALL SELECT DISTINCT key, 1, 0.01 FROM t WHERE key NOT IN (SELECT key FROM v)),
s AS (SELECT q.key AS query_id, a.key, round(sum(q.weight * a.weight), 6) AS score FROM a q JOIN a USING (token) WHERE q.key % 100 = 0 GROUP BY ALL)
SELECT query_id, key, round(score, 2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS rank0 FROM s QUALIFY rank0 < 10""")  # fmt: skip
def given_sparse_weights(spark, sf_dir):
    """Users by the weights of their events: the greatest of a token counts, special tokens and weights of zero do not."""
    tokens = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 50).alias("token"), F.round("value", 2).alias("weight"))
    v = S.sparse_vectors(tokens)
    return S.sparse_dot(v.filter("key % 100 = 0").withColumnRenamed("key", "query_id"), v, 10).withColumn("score", F.round("score", 2))


@query("revisions_marked", """
SELECT c_custkey, c_name || '>' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '|' || c_custkey || '>' || c_nationkey ELSE '' END AS marks FROM customer""")
def revisions_marked(spark, sf_dir):
    """Marks of a change in a line about each customer, a second one for every other, with the arrow written both ways."""
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" [修改前:"), text_of("c_custkey"), F.lit("-&gt; 修改后: "), text_of("c_nationkey"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("x [修改前: "), "c_name", F.lit(" -> 修改后:"), "c_mktsegment", F.lit(" ] y"), second)
    marks = F.transform(X.revisions(line), lambda r: F.concat(r["before"], F.lit(">"), r["after"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(marks, "|").alias("marks"))


@query("answers_as_json", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS body FROM events")
def answers_as_json(spark, sf_dir):
    """The JSON of an answer, behind what was thought, in a fence or in a sentence, or none."""
    m, p = F.col("event_id") % 4, F.col("props")
    said = F.when(m == 0, F.concat(F.lit('a <think>{"no": 1}</think> '), p, F.lit(" end"))).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("so: "), p)).otherwise("nothing here")
    return table(spark, sf_dir, "events").select("event_id", X.json_body(said).alias("body"))


@query("names_made_safe", r"""
SELECT p_partkey, regexp_replace(regexp_replace(p_name || '/' || p_brand || ' ?' || p_size || '.txt', '[^A-Za-z0-9_一-龥.\-]', '_', 'g'), '_{2,}', '_', 'g') AS name, '地形图 ' || p_name || ' 田型' AS title FROM part""")
def names_made_safe(spark, sf_dir):
    """File names without marks that a path can't hold, and titles with spellings put right."""
    raw = F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ?"), text_of("p_size"), F.lit(".txt"))
    title = X.replaced(F.concat(F.lit("地型图 "), "p_name", F.lit(" 田形")), S.TYPOS)
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(raw).alias("name"), title.alias("title"))


@query("references_without_files", """
WITH r AS (SELECT l_orderkey AS ref_id, list(DISTINCT l_suppkey::VARCHAR) AS a FROM lineitem GROUP BY 1 UNION ALL SELECT -c_custkey, [] FROM customer),
x AS (SELECT ref_id, len(a) AS had, list_sort(list_filter(a, lambda x: x NOT IN ('1', '2', '3'))) AS left_ids FROM r)
SELECT ref_id, array_to_string(left_ids, ',') AS file_ids FROM x WHERE had = 0 OR len(left_ids) > 0""")  # fmt: skip
def references_without_files(spark, sf_dir):
    """Orders as references to their suppliers' files, customers as references to all files; three files are gone."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ref_id")).agg(F.collect_set(text_of("l_suppkey")).alias("file_ids"))
    r = r.unionByName(table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("ref_id"), F.array().cast("array<string>").alias("file_ids")))
    return R.without_ids(r, ["1", "2", "3"]).select("ref_id", F.array_join(F.array_sort("file_ids"), ",").alias("file_ids"))


@query("texts_pasted", "SELECT doc_id, 'text' AS source_type FROM documents WHERE length(trim(text)) >= 10")
def texts_pasted(spark, sf_dir):
    return readers.pasted(table(spark, sf_dir, "documents")).select("doc_id", "source_type")


@query("sections_left", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sections_left(spark, sf_dir):
    """Orders that a resumed job still has to do: those without a returned item."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.unfinished(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("saved_documents", "SELECT doc_id AS id, source AS title, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_sections, n_chars AS updated_at FROM documents")
def saved_documents(spark, sf_dir):
    """Documents without their bodies, with the number of their sections (lines)."""
    sections = F.split(F.coalesce("text", F.lit("")), "\n")
    return R.document_listing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), sections.alias("sections"), F.col("n_chars").alias("updated_at")))


@query("triples_with_communities", f"""
WITH {EDGES}, k AS (SELECT 'n' || n_nationkey AS name, n_name AS type FROM nation), m AS (SELECT 's' || s_suppkey AS node, s_nationkey::VARCHAR AS community_id FROM supplier)
SELECT src, relation, dst, a.type AS s_type, b.type AS o_type, community_id FROM e LEFT JOIN k a ON a.name = src LEFT JOIN k b ON b.name = dst LEFT JOIN m ON m.node = src""")
def triples_with_communities(spark, sf_dir):
    """Edges with the types of their ends and the community of the subject, where there is one."""
    types = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), text_of("n_nationkey")).alias("name"), F.col("n_name").alias("type"))
    members = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text_of("s_suppkey")).alias("node"), text_of("s_nationkey").alias("community_id"))
    return G.communities_of(edges(spark, sf_dir), types, members)


@query("elements_of_documents", f"""
WITH {WINDOWS}, x AS (SELECT doc_id::VARCHAR AS src, 'HAS_ELEMENT' AS relation, doc_id || '#' || k AS dst FROM w)
SELECT src, relation, dst FROM x UNION ALL SELECT 'figures', 'EVIDENCE_BY', doc_id || '#' || k FROM w WHERE regexp_matches(document, '[0-9]')""")
def elements_of_documents(spark, sf_dir):
    """Documents to their chunks, and the field `figures` to the chunks that hold a digit."""
    fields = F.when(F.col("document").rlike("[0-9]"), F.array(F.lit("figures"))).otherwise(F.array().cast("array<string>"))
    return G.document_tree(chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "document"), fields)


@query("measures_of_lineitem", """
WITH n AS (SELECT 'l_AREA' AS "column", count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT '投资金额', count(*), round(sum(l_extendedprice), 2) FROM lineitem),
t AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL)
SELECT 'number' AS kind, "column", n, total, NULL AS value FROM n UNION ALL SELECT 'text', "column", n, NULL, value FROM t QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5""")  # fmt: skip
def measures_of_lineitem(spark, sf_dir):
    """Columns named by business words are measures; texts that are no keys give their most frequent values."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("l_AREA"), F.col("l_extendedprice").alias("投资金额"), "l_discount", "l_returnflag", "l_linestatus")
    numeric, texts = R.business_profile(d, ("AREA", "金额"))
    a = numeric.select(F.lit("number").alias("kind"), "column", "n", "total", F.lit(None).cast("string").alias("value"))
    return a.unionByName(texts.select(F.lit("text").alias("kind"), "column", "n", F.lit(None).cast("double").alias("total"), "value"))


@query("lines_of_drawings", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, 'K' || l_partkey || chr(10) || l_quantity::INT || '.5' || chr(10) || '+ ' || l_suppkey || chr(10) || '- 1' AS text FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(trim(x), '[\d.+\-\s]{1,6}')), chr(10)) AS text FROM t""")
def lines_of_drawings(spark, sf_dir):
    """Lines of a few digits and marks go, longer ones and words stay."""
    text = F.concat_ws("\n", F.concat(F.lit("K"), text_of("l_partkey")), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")), F.concat(F.lit("+ "), text_of("l_suppkey")), F.lit("- 1"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), X.without_drawing_noise(text).alias("text"))


@query("lists_of_citations", r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(CASE WHEN doc_id % 3 = 0 THEN '《' || x || '》' ELSE x END)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, len(a) > 0 AND len(list_filter(a, lambda x: regexp_matches(x, '《.+?》|[（(][A-Z]{1,4}[/T]?\d|〔\d{4}〕|GB[/T]|DB\d|SL[/T]|JTG'))) * 2 > len(a) AND len(list_filter(a, lambda x: length(x) > 80)) <= 2 AS listed FROM l""")
def lists_of_citations(spark, sf_dir):
    """Documents whose lines are mostly citations: every third document has its lines set in the marks of titles."""
    d = table(spark, sf_dir, "documents")
    cited = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("《"), x, F.lit("》"))), "\n")
    return d.select("doc_id", X.is_citation_list(F.when(F.col("doc_id") % 3 == 0, cited).otherwise(F.col("text"))).alias("listed"))


@query("short_greetings", r"""
WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '你好 ' || left(coalesce(text, ''), 3 * (conv_id % 2)::INT) ELSE coalesce(text, '') END AS t FROM conversations)
SELECT conv_id, turn, length(lower(trim(t))) <= 40 AND (list_contains(GREETED, regexp_replace(lower(trim(t)), '[^A-Za-z0-9_一-龥]', '', 'g')) OR regexp_matches(lower(trim(t)), 'ASKED')) AS simple FROM m
""".replace("GREETED", "[" + ", ".join(f"'{w}'" for w in N.GREETINGS) + "]").replace("ASKED", "|".join(N.IDENTITY)))  # fmt: skip
def short_greetings(spark, sf_dir):
    """Turns that are greetings: every other turn greets, with or without a few letters of its text behind."""
    t = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("你好 "), F.substring(t, F.lit(1), (3 * (F.col("conv_id") % 2)).cast("int")))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.is_simple(said).alias("simple"))
