"""Document ETL: chunking, tagging, cleaning and language rules over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import identity as I
from brindle.functions import nlp as N
from brindle.functions import text as X
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.session import table
from brindle.sources import readers

# DuckDB's form of fixed windows: chunks of 512 characters, a step of 448.
WINDOWS = """
w AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS k, unnest(c) AS document FROM (
        SELECT doc_id, list_filter([trim(substr(coalesce(text, ''), i + 1, 512)) FOR i IN range(0, greatest(length(coalesce(text, '')), 1), 448)], lambda x: x <> '') AS c FROM documents))"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def chunks(spark, sf_dir):
    """(doc_id, chunk_index, total_chunks, document): fixed windows of documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = d.select("doc_id", X.window_chunks(F.col("text")).alias("c"))
    return c.select("doc_id", F.posexplode("c").alias("chunk_index", "document"), F.size("c").alias("total_chunks"))


@query("fixed_window_chunks", f"WITH {WINDOWS} SELECT doc_id, k::BIGINT AS chunk_index, md5(document) AS hash, length(document)::BIGINT AS n_chars FROM w")
def fixed_window_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.col("document").cast("binary")).alias("hash"), F.length("document").cast("bigint").alias("n_chars"))


@query("chunk_dedupe", f"""
WITH l AS (SELECT doc_id, unnest(list_distinct([{STRIP.format('x')} FOR x IN string_split(coalesce(text, ''), chr(10))])) AS line FROM documents)
SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY 1""")  # fmt: skip
def chunk_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = X.explode_chunks(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.split("text", "\n"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("document")).alias("n_chars"))


@query("context_prefix", f"""
WITH {WINDOWS} SELECT doc_id, k::BIGINT AS chunk_index, md5('[文档：doc' || doc_id || ']' || coalesce(' 前文：' || replace(substr(lag(document) OVER (PARTITION BY doc_id ORDER BY k), 1, 60), chr(10), ' ') || '…', '') || chr(10) || document) AS hash FROM w""")  # fmt: skip
def context_prefix(spark, sf_dir):
    c = X.context_prefix(chunks(spark, sf_dir), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.col("contextual").cast("binary")).alias("hash"))


@query("chunk_confidence", rf"""
WITH {WINDOWS}, s AS (SELECT doc_id, k, {STRIP.format('document')} AS t FROM w),
m AS (SELECT doc_id, k, t, length(t) AS n, length(regexp_replace(t, '[^一-鿿]', '', 'g')) / length(t) AS cjk,
       len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) = 1)) / len(string_split(t, chr(10))) AS lone,
       length(regexp_replace(t, '[\p{{L}}\p{{N}}，。、；：！？"''（）《》【】\n\t .\-·/%+=]', '', 'g')) / length(t) AS noise,
       (contains(t, 'the')::INT + contains(t, 'and')::INT + contains(t, 'der')::INT + contains(t, 'que')::INT + contains(t, 'ing')::INT + contains(t, 'tion')::INT) AS hits FROM s)
SELECT doc_id, k::BIGINT AS chunk_index, greatest(0, least(100, 50 + CASE WHEN cjk > 0.4 THEN 20 WHEN cjk > 0.2 THEN 10 WHEN cjk < 0.05 AND n > 50 THEN -20 ELSE 0 END
  + CASE WHEN n >= 200 THEN 10 WHEN n < 50 THEN -15 ELSE 0 END - CASE WHEN lone > 0.3 THEN 20 ELSE 0 END - CASE WHEN noise > 0.15 THEN 15 ELSE 0 END
  + CASE WHEN hits >= 5 THEN 20 WHEN hits >= 2 THEN 10 ELSE 0 END)) / 100 AS confidence FROM m""")  # fmt: skip
def chunk_confidence(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), X.confidence(F.col("document"), ["the", "and", "der", "que", "ing", "tion"]).alias("confidence"))


LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    return d.select("doc_id", F.posexplode("l").alias("line_no", "line"))


@query("semantic_role", rf"""
WITH {LINES}, t AS (SELECT {STRIP.format('line')} AS t FROM l)
SELECT CASE WHEN t = '' THEN 'text_block' WHEN regexp_matches(t, '^(#{{1,6}}\s+\S|第[一二三四五六七八九十]+[章节条款篇])') THEN 'section_header'
            WHEN regexp_matches(t, '^\s*\|.*\|\s*$') THEN 'table' WHEN regexp_matches(t, '^\s*([-*+]|\d+\.)\s+\S') THEN 'list_item' ELSE 'text_block' END AS role,
       count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM t GROUP BY 1""")  # fmt: skip
def semantic_role(spark, sf_dir):
    t = lines(spark, sf_dir).select(X.stripped(F.col("line")).alias("t"))
    return t.groupBy(X.semantic_role(F.col("t")).alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("n_chars"))


@query("heading_level", rf"""
WITH t AS (SELECT i, k::VARCHAR || '.' || (k + i)::VARCHAR || CASE WHEN i % 3 = 0 THEN '.' || i::VARCHAR ELSE '' END || ' ' || c_name AS t
           FROM (SELECT c_custkey AS i, c_nationkey AS k, c_name FROM customer)
           UNION ALL SELECT c_custkey, c_custkey::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN '. ' ELSE '.' END || c_name FROM customer
           UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '第三章 ' ELSE '（二）' END || c_name FROM customer)
SELECT i, t, CASE WHEN regexp_matches(t, '^([一二三四五六七八九十百千万]+、|第[一二三四五六七八九十百千万]+章\s)') THEN 1 WHEN regexp_matches(t, '^\d+\.\d+\.\d+\.\d+') THEN 4
  WHEN regexp_matches(t, '^\d+\.\d+\.\d+') THEN 3 WHEN regexp_matches(t, '^(\d+\.\d+|（[一二三四五六七八九十百千万]+）)') THEN 2 WHEN regexp_matches(t, '^\d+\.?\s+\S') THEN 1
  WHEN regexp_matches(t, '^第\d+节\s') THEN 2 ELSE 0 END AS level FROM t""")  # fmt: skip
def heading_level(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("k"), "c_name")
    s = lambda x: x.cast("string")
    a = F.concat(s(F.col("k")), F.lit("."), s(F.col("k") + F.col("i")), F.when(F.col("i") % 3 == 0, F.concat(F.lit("."), s(F.col("i")))).otherwise(""), F.lit(" "), "c_name")
    b = F.concat(s(F.col("i")), F.when(F.col("i") % 2 == 0, ". ").otherwise("."), "c_name")
    d = F.concat(F.when(F.col("i") % 2 == 0, "第三章 ").otherwise("（二）"), "c_name")
    t = c.select("i", F.explode(F.array(a, b, d)).alias("t"))
    return t.select("i", "t", X.heading_level(F.col("t")).alias("level"))


@query("document_sections", r"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
h AS (SELECT *, CASE WHEN no % 4 = 0 THEN 1 ELSE 0 END AS head FROM l), s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS k FROM h)
SELECT doc_id, k::BIGINT AS section_no, count(*) FILTER (WHERE head = 0) AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE head = 0), '')) AS hash FROM s GROUP BY 1, 2""")  # fmt: skip
def document_sections(spark, sf_dir):
    numbered = F.when((F.col("line_no") + 1) % 4 == 0, F.concat(F.lit("1 "), "line", F.lit("x"))).otherwise(F.concat(F.lit("~"), "line"))
    s = X.sections(lines(spark, sf_dir).withColumn("line", numbered))
    content = F.regexp_replace(F.col("content"), r"(^|\n)~", "$1")
    n = F.when(F.col("content") == "", 0).otherwise(F.regexp_count("content", F.lit(r"(^|\n)~")))
    return s.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), n.cast("bigint").alias("n_lines"), F.md5(content.cast("binary")).alias("hash"))


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """Chunks along paragraphs; a fold in order of the text, tested against its definition."""
    d = table(spark, sf_dir, "documents")
    c = X.explode_chunks(d, X.paragraph_chunk_column(F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return c.select("doc_id", "chunk_index", "total_chunks", F.length("document").alias("n_chars"), I.chunk_id(F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("chunk_index")).alias("chunk_id"))


@query("chunk_estimate", """
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, length(text) // CASE WHEN source = 'src2' THEN 420 ELSE 500 END) END::BIGINT AS n FROM documents""")
def chunk_estimate(spark, sf_dir):
    name = F.when(F.col("source") == "src2", "a.XLSX").otherwise("a.txt")
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_estimate(F.col("text"), name).alias("n"))


@query("document_summary", f"""
WITH {WINDOWS}, g AS (SELECT doc_id, list(document ORDER BY k) AS c FROM w GROUP BY 1),
s AS (SELECT doc_id, c, CASE WHEN doc_id % 2 = 0 AND len(c) > 3
   THEN substr(array_to_string([substr(c[i + 1], 1, 200) FOR i IN list_filter(range(0, len(c)), lambda x: x % greatest(1, len(c) // 8) = 0)[1:10]], chr(10) || chr(10)), 1, 2000)
   ELSE substr(array_to_string(c[1:3], chr(10) || chr(10)), 1, 1500) END AS t FROM g)
SELECT doc_id, CASE WHEN len(c) > 1 AND t <> c[1] THEN md5(t) END AS hash FROM s""")  # fmt: skip
def document_summary(spark, sf_dir):
    g = chunks(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "document"))), lambda x: x["document"]).alias("c"))
    return g.select("doc_id", F.md5(X.document_summary(F.col("c"), F.col("doc_id") % 2 == 0).cast("binary")).alias("hash"))


@query("chunk_length_histogram", f"""
WITH {WINDOWS}, b AS (SELECT * FROM (VALUES ('0-128', 0, 128), ('128-256', 128, 256), ('256-512', 256, 512), ('512-1024', 512, 1024), ('1024+', 1024, 1000000000)) v(bucket, lo, hi))
SELECT bucket, count(w.document) AS n FROM b LEFT JOIN w ON length(w.document) >= lo AND length(w.document) < hi GROUP BY 1""")  # fmt: skip
def chunk_length_histogram(spark, sf_dir):
    return R.histogram(chunks(spark, sf_dir), F.length("document"), [0, 128, 256, 512, 1024])


@query("file_chunk_stats", f"""
WITH {WINDOWS} SELECT doc_id, count(*) AS chunks, sum(length(document))::BIGINT AS chars, bool_or(length(document) >= 512) AS has_full FROM w GROUP BY 1""")
def file_chunk_stats(spark, sf_dir):
    """Chunks of texts; a summary that stands for each file beside them does not count."""
    c = chunks(spark, sf_dir).select("doc_id", "document", F.lit("text").alias("chunk_type"))
    summaries = c.groupBy("doc_id").agg(F.first("document").alias("document")).withColumn("chunk_type", F.lit("doc_summary"))
    return R.chunk_stats(c.unionByName(summaries))


@query("exact_dup_docs", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("content_hash_clone", """
WITH a AS (SELECT sha256(text) AS h, min(doc_id) AS src FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT d.doc_id, a.src AS cloned_from FROM documents d JOIN a ON sha256(d.text) = a.h WHERE d.doc_id % 2 = 1""")  # fmt: skip
def content_hash_clone(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", I.content_hash(F.col("text")).alias("h"))
    have = d.filter("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("cloned_from"))
    return d.filter("doc_id % 2 = 1").join(have, "h").select("doc_id", "cloned_from")


@query("identity_keys", """
SELECT doc_id, md5('p1_' || source) AS file_id, md5('p1_web_' || source) AS web_id, md5('p1_text_' || source) AS text_id FROM documents""")
def identity_keys(spark, sf_dir):
    p, s = F.lit("p1"), F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", I.file_id(p, s).alias("file_id"), I.web_file_id(p, s).alias("web_id"), I.text_file_id(p, s).alias("text_id"))


@query("page_text_extract", r"""
WITH a AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<head[^>]*>.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT *, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS u FROM a)
SELECT page_id, CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE url END AS title,
       md5(trim(regexp_replace(u, '[ \t\r\n]+', ' ', 'g'))) AS hash FROM b""")  # fmt: skip
def page_text_extract(spark, sf_dir):
    return readers.web_sources(table(spark, sf_dir, "pages")).select("page_id", "title", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("page_upsert", "SELECT url, max(page_id) AS page_id FROM pages GROUP BY 1")
def page_upsert(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "pages"), "url", F.col("page_id")).select("url", "page_id")


@query("form_titles", r"""
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) <> '' THEN regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)
  ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS title FROM pages""")  # fmt: skip
def form_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.form_title(F.col("html")).alias("title"))


@query("file_listing", """
SELECT url AS path, length(html)::BIGINT AS size, 'web' AS kind FROM pages UNION ALL SELECT 'f/' || source || '.shp', sum(n_chars)::BIGINT, 'shp' FROM documents GROUP BY 1""")
def file_listing(spark, sf_dir):
    parts = F.concat(F.lit("f/"), "source", F.when(F.col("doc_id") % 2 == 0, ".shp").otherwise(".dbf"))
    files = table(spark, sf_dir, "documents").select(parts.alias("path"), F.col("n_chars").alias("size"))
    return readers.listing(files, table(spark, sf_dir, "pages").withColumnRenamed("html", "text"))


@query("scanned_files", "SELECT source AS file_id, coalesce(avg(length(trim(coalesce(text, '')))), 0) < 80 AS scanned FROM documents GROUP BY 1")
def scanned_files(spark, sf_dir):
    return readers.is_scanned(table(spark, sf_dir, "documents").withColumnRenamed("source", "file_id"))


@query("history_budget", """
WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role ROWS UNBOUNDED PRECEDING) AS used FROM conversations
           QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) <= 12)
SELECT conv_id, turn, used::BIGINT AS used FROM r WHERE used <= 3000""")  # fmt: skip
def history_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    c = c.withColumn("k", F.row_number().over(w)).filter("k <= 12")
    return R.within_budget(c, "conv_id", F.length("text"), 3000, F.desc("turn"), F.asc("role")).select("conv_id", "turn", "used")


@query("context_budget", f"""
WITH {WINDOWS}, s AS (SELECT doc_id, k, sum(length(document) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS used FROM w)
SELECT doc_id, max(k)::BIGINT AS last_chunk, max(used)::BIGINT AS used FROM s WHERE used <= 25000 GROUP BY 1""")  # fmt: skip
def context_budget(spark, sf_dir):
    d = R.within_budget(chunks(spark, sf_dir), "doc_id", F.length("document") + 2, 25_000, F.asc("chunk_index"))
    return d.groupBy("doc_id").agg(F.max("chunk_index").cast("bigint").alias("last_chunk"), F.max("used").alias("used"))


@query("section_class", r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
c AS (SELECT *, len(list_filter(l, lambda x: starts_with(trim(x), '|'))) AS rows FROM t)
SELECT doc_id, CASE WHEN rows = 0 AND regexp_matches(text, '表\s*\d') THEN 'reference' WHEN rows = 0 THEN 'text' WHEN rows / len(l) < 0.6 THEN 'mixed' ELSE 'table' END AS class FROM c""")  # fmt: skip
def section_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.table_line_class(F.col("text")).alias("class"))


@query("facts_limits", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 500 ELSE greatest(1000, least(length(text) * 5, 8000)) END::BIGINT AS interactive, CASE WHEN doc_id % 3 = 0 THEN 500 ELSE 8000 END::BIGINT AS batch FROM documents""")
def facts_limits(spark, sf_dir):
    listed = F.col("doc_id") % 3 == 0
    return table(spark, sf_dir, "documents").select("doc_id", X.facts_limit(F.col("text"), listed, False).cast("bigint").alias("interactive"), X.facts_limit(F.col("text"), listed, True).cast("bigint").alias("batch"))


@query("segment_cap", """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
SELECT doc_id, least(len(a), 10)::BIGINT AS n, md5(CASE WHEN len(a) <= 10 THEN a[-1] ELSE array_to_string(a[10:], chr(10)) END) AS last_hash FROM s""")  # fmt: skip
def segment_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.capped_segments(F.split(F.coalesce("text", F.lit("")), "\n"), 10, "\n").alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.element_at("s", -1).cast("binary")).alias("last_hash"))


@query("title_strip", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, t, split_part(t, ' ', 1) AS title FROM t)
SELECT doc_id, md5(CASE WHEN title <> '' THEN regexp_replace(substr(t, length(title) + 1), '^[\s:：]+', '') ELSE t END) AS hash FROM s""")  # fmt: skip
def title_strip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.md5(X.without_title(F.col("text"), F.substring_index(X.stripped(F.col("text")), " ", 1)).cast("binary")).alias("hash"))


@query("term_frequency", r"""
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 15""")
def term_frequency(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,}"), 0)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(15)


@query("number_verify", r"""
WITH c AS (SELECT conv_id, turn, text || ' ' || (conv_id * 37 % 5000)::VARCHAR AS a, 'x ' || (turn + 12)::VARCHAR AS s FROM conversations WHERE text IS NOT NULL),
n AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(a, '\d+(?:\.\d+)?'))) AS v, regexp_extract_all(s, '\d+(?:\.\d+)?') AS known FROM c),
f AS (SELECT *, v::DOUBLE AS d FROM n WHERE NOT list_contains(known, v)),
o AS (SELECT * FROM f WHERE d >= 10 AND NOT (d = floor(d) AND (d BETWEEN 0 AND 31 OR d BETWEEN 1990 AND 2034 OR d IN (100, 1000, 10000))) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY d DESC, v) <= 3)
SELECT conv_id, turn, v AS number, d > 1000 AS severe FROM o""")  # fmt: skip
def number_verify(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    answer = F.concat("text", F.lit(" "), (F.col("conv_id") * 37 % 5000).cast("string"))
    found = R.unsupported_numbers(answer, F.concat(F.lit("x "), (F.col("turn") + 12).cast("string")))
    return c.select("conv_id", "turn", F.explode(found).alias("f")).select("conv_id", "turn", "f.number", "f.severe")


@query("intent_rules", """
SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'the|une') THEN 'data_analysis' WHEN regexp_matches(text, 'der|que') THEN 'table_stats' ELSE 'general_qa' END AS intent FROM conversations WHERE text IS NOT NULL""")
def intent_rules(spark, sf_dir):
    words = {"data_analysis": "the une", "table_stats": "der que"}
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", N.intent(F.col("text"), words).alias("intent"))


@query("intent_scores", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c, (l_quantity % 10) / 10 AS v, l_discount * 5 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d >= 0.7 THEN 'data_analysis' WHEN a >= 0.7 THEN 'table_stats' WHEN a >= 0.5 AND v < 0.6 THEN 'data_lookup' WHEN b >= 0.7 THEN 'graph_focus'
       WHEN c >= 0.7 THEN 'summary' WHEN v >= 0.5 AND c >= 0.5 THEN 'comparison' ELSE 'general_qa' END AS intent FROM s""")  # fmt: skip
def intent_scores(spark, sf_dir):
    c = F.col
    i = N.intent_of_scores(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50, (c("l_quantity") % 10) / 10, c("l_discount") * 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", i.alias("intent"))


@query("query_rewrite", r"""
WITH m AS (SELECT item_id, text || ' K12+300 45 km A7x 45 KM' AS m FROM benchmark),
c AS (SELECT item_id, list_concat(regexp_extract_all(m, '[a-zA-Z]?\d+\+\d+(?:\.\d+)?|[a-zA-Z0-9_-]*[a-zA-Z][a-zA-Z0-9_-]*\d[a-zA-Z0-9_-]*|[a-zA-Z0-9_-]*\d[a-zA-Z0-9_-]*[a-zA-Z][a-zA-Z0-9_-]*'), regexp_extract_all(m, '(?i)\d+\s*(?:min|h|d|s|ms|km|m|mm|cm|ha|亩|吨|kg|MPa)')[1:3]) AS t FROM m),
u AS (SELECT item_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM c),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id, lower(replace(t, ' ', '')) ORDER BY k) = 1)
SELECT item_id, 'p ' || string_agg(t, ' ' ORDER BY k) AS rewritten FROM f GROUP BY 1""")  # fmt: skip
def query_rewrite(spark, sf_dir):
    m = F.concat("text", F.lit(" K12+300 45 km A7x 45 KM"))
    return table(spark, sf_dir, "benchmark").select("item_id", N.rewritten(m, F.lit("p")).alias("rewritten"))


@query("coref_last_turn", r"""
WITH l AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN reply IS NOT NULL AND regexp_matches(text, 'the|la') AND len(regexp_extract_all(substr(reply, 1, 500), '[a-z]{6,8}')) > 0
  THEN text || ' ' || array_to_string(regexp_extract_all(substr(reply, 1, 500), '[a-z]{6,8}')[1:5], ' ') ELSE text END AS resolved FROM l WHERE role = 'user'""")  # fmt: skip
def coref_last_turn(spark, sf_dir):
    d = N.last_reply(table(spark, sf_dir, "conversations")).filter("role = 'user'")
    return d.select("conv_id", "turn", N.resolved(F.col("text"), F.col("reply"), ["the", "la"], "[a-z]{6,8}").alias("resolved"))


@query("form_fields", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, 'the|der') THEN 'a' END, CASE WHEN regexp_matches(text, '\b[0-9]{3}\b') THEN 'b' END, CASE WHEN regexp_matches(text, '@') THEN 'c' END], lambda x: x IS NOT NULL), ',') AS fields
FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def form_fields(spark, sf_dir):
    fields = {"a": "the|der", "b": r"\b[0-9]{3}\b", "c": "@"}
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_join(N.form_fields(F.col("text"), fields), ",").alias("fields"))


@query("judge_scores", """
SELECT doc_id, greatest(0.0, least(1.0, coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE (quality + doc_id % 2 / 2)::VARCHAR END AS DOUBLE), 0.5))) AS score FROM labels""")
def judge_scores(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, "none").otherwise((F.col("quality") + F.col("doc_id") % 2 / 2).cast("string"))
    return table(spark, sf_dir, "labels").select("doc_id", N.judged(raw).alias("score"))


@query("event_properties", """
SELECT event_type, count(*) AS n, count(DISTINCT props->>'$.page') AS pages FROM events GROUP BY 1""")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.page")).alias("pages"))
