"""Entity graphs made of parts, suppliers and customers: merging, expansion, ranking and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.session import table

EDGES = """e AS (SELECT 's' || s_suppkey AS src, 'in' AS relation, 'n' || s_nationkey AS dst FROM supplier
               UNION ALL SELECT 'n' || n_nationkey, 'of', 'r' || n_regionkey FROM nation)"""


def edges(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("src"), F.lit("in").alias("relation"), name("n", "s_nationkey").alias("dst"))
    return s.unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), F.lit("of").alias("relation"), name("r", "n_regionkey").alias("dst")))


TRIPLES = """t AS (SELECT 'p' AS project_id, (l_orderkey % 20)::VARCHAR AS file_id, l_orderkey * 10 + l_linenumber AS seq, 's' || l_suppkey AS subject, l_returnflag AS relation, 'f' || (l_partkey % 50) AS object,
                 'supplier' || (l_orderkey % 3) AS s_type, 'part' AS o_type FROM lineitem)"""


def triples(spark, sf_dir):
    t = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("p").alias("project_id"), (F.col("l_orderkey") % 20).cast("string").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("s"), t("l_suppkey")).alias("subject"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("object"),
        F.concat(F.lit("supplier"), (F.col("l_orderkey") % 3).cast("string")).alias("s_type"), F.lit("part").alias("o_type"),
    )


@query("edge_merge", f"WITH {TRIPLES} SELECT project_id, subject AS src, relation, object AS dst, arg_min(file_id, seq) AS file_id FROM t GROUP BY ALL")
def edge_merge(spark, sf_dir):
    return G.merged_triples(triples(spark, sf_dir))[1]


@query("entity_merge_types", f"""
WITH {TRIPLES}, x AS (SELECT project_id, file_id, seq, subject AS name, s_type AS type FROM t UNION ALL SELECT project_id, file_id, seq, object, o_type FROM t)
SELECT project_id, name, arg_min(type, seq) AS type, count(DISTINCT file_id) AS n_files FROM x GROUP BY 1, 2""")  # fmt: skip
def entity_merge_types(spark, sf_dir):
    v = G.merged_triples(triples(spark, sf_dir))[0]
    return v.select("project_id", "name", "type", F.size("file_ids").cast("bigint").alias("n_files"))


@query("n_hop_paths", f"""
WITH {EDGES}, b AS (SELECT src || relation || dst AS id, src, dst, relation FROM e UNION ALL SELECT src || relation || dst, dst, src, relation FROM e),
h1 AS (SELECT 's' || s_suppkey AS seed, b.dst AS node, ['s' || s_suppkey, b.dst] AS nodes, [b.relation] AS rels, [b.id] AS used FROM supplier JOIN b ON b.src = 's' || s_suppkey),
h2 AS (SELECT seed, b.dst AS node, list_append(nodes, b.dst) AS nodes, list_append(rels, b.relation) AS rels, list_append(used, b.id) AS used FROM h1 JOIN b ON b.src = node WHERE NOT list_contains(used, b.id)),
h3 AS (SELECT seed, b.dst AS node, list_append(nodes, b.dst) AS nodes, list_append(rels, b.relation) AS rels, list_append(used, b.id) AS used FROM h2 JOIN b ON b.src = node WHERE NOT list_contains(used, b.id)),
a AS (SELECT seed, node, 1 AS distance, nodes, rels FROM h1 UNION ALL SELECT seed, node, 2, nodes, rels FROM h2 UNION ALL SELECT seed, node, 3, nodes, rels FROM h3)
SELECT seed, node, distance, nodes[1] || array_to_string([ '（' || rels[i] || '）' || nodes[i + 1] FOR i IN range(1, len(nodes))], '') AS path FROM a""")  # fmt: skip
def n_hop_paths(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))
    return G.all_paths(edges(spark, sf_dir), seeds, 3).select("seed", "node", "distance", "path")


@query("ranked_paths", f"""
WITH {EDGES}, b AS (SELECT src || relation || dst AS id, src, dst, relation FROM e UNION ALL SELECT src || relation || dst, dst, src, relation FROM e),
g AS (SELECT src AS node, count(*)::DOUBLE AS degree FROM b GROUP BY src),
h1 AS (SELECT 's' || s_suppkey AS seed, b.dst AS node, ['s' || s_suppkey, b.dst] AS nodes, [b.relation] AS rels, [b.id] AS used FROM supplier JOIN b ON b.src = 's' || s_suppkey),
h2 AS (SELECT seed, b.dst AS node, list_append(nodes, b.dst) AS nodes, list_append(rels, b.relation) AS rels, list_append(used, b.id) AS used FROM h1 JOIN b ON b.src = node WHERE NOT list_contains(used, b.id)),
h3 AS (SELECT seed, b.dst AS node, list_append(nodes, b.dst) AS nodes, list_append(rels, b.relation) AS rels, list_append(used, b.id) AS used FROM h2 JOIN b ON b.src = node WHERE NOT list_contains(used, b.id)),
a AS (SELECT seed, node, 1 AS distance, nodes, rels FROM h1 UNION ALL SELECT seed, node, 2, nodes, rels FROM h2 UNION ALL SELECT seed, node, 3, nodes, rels FROM h3)
SELECT seed, node, distance, degree, nodes[1] || array_to_string([ '（' || rels[i] || '）' || nodes[i + 1] FOR i IN range(1, len(nodes))], '') AS path,
  row_number() OVER (PARTITION BY seed ORDER BY degree DESC, distance, nodes, rels) - 1 AS rank0 FROM a JOIN g USING (node) QUALIFY rank0 < 20""")  # fmt: skip
def ranked_paths(spark, sf_dir):
    """The twenty paths of each supplier that end at the nodes of most edges."""
    e = edges(spark, sf_dir)
    degree = G.both_ways(e).groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("pagerank"))
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))
    h = G.ranked_paths(e, seeds, degree, 3, 20)
    return h.select("seed", "node", "distance", F.col("pagerank").alias("degree"), G.rendered(F.col("nodes"), F.col("relations")).alias("path"), "rank0")


@query("pagerank")
def pagerank(spark, sf_dir):
    """Ranks of the undirected graph; iterative, tested against a dense solution."""
    return G.pagerank(edges(spark, sf_dir))


@query("communities", """
SELECT 'p_comm_' || md5(string_agg(x, ',' ORDER BY x)) AS community_id, count(*) AS n FROM (
  SELECT DISTINCT n_regionkey, 'n' || n_nationkey AS x FROM nation UNION SELECT DISTINCT n_regionkey, 'r' || n_regionkey FROM nation
  UNION SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_regionkey HAVING count(*) >= 3""")  # fmt: skip
def communities(spark, sf_dir):
    c = G.communities(edges(spark, sf_dir))
    return c.select("community_id", F.size("members").cast("bigint").alias("n"))


@query("community_changes", """
SELECT c_custkey AS community_id, 'new' AS change FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'obsolete' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def community_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("community_id"))
    return G.community_changes(c.filter("community_id % 3 = 0"), c.filter("community_id % 2 = 0"))


@query("intra_community_edges", f"""
WITH {EDGES}, m AS (SELECT n_regionkey AS community_id, 'n' || n_nationkey AS node FROM nation UNION ALL SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.community_id, e.src, e.relation, e.dst FROM e JOIN m a ON e.src = a.node JOIN m b ON e.dst = b.node AND a.community_id = b.community_id""")  # fmt: skip
def intra_community_edges(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node")
    a = n.select(F.col("n_regionkey").alias("community_id"), name("n", "n_nationkey"))
    b = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("community_id"), name("s", "s_suppkey"))
    return G.inner_edges(edges(spark, sf_dir), a.unionByName(b))


@query("entity_candidates", """
WITH n AS (SELECT DISTINCT p_type AS type, p_name AS name FROM part),
p AS (SELECT x.type, x.name AS a, y.name AS b FROM n x JOIN n y ON x.type = y.type AND x.name < y.name),
g AS (SELECT *, list_distinct([substr(a, i, 2) FOR i IN range(1, length(a))]) AS ga, list_distinct([substr(b, i, 2) FOR i IN range(1, length(b))]) AS gb,
   len(list_intersect(list_distinct([substr(lower(a), i, 2) FOR i IN range(1, length(a))]), list_distinct([substr(lower(b), i, 2) FOR i IN range(1, length(b))]))) AS met FROM p),
d AS (SELECT *, len(list_filter(list_concat(list_filter(ga, lambda x: NOT list_contains(gb, x)), list_filter(gb, lambda x: NOT list_contains(ga, x))), lambda x: regexp_matches(x, '[0-9]'))) AS digits FROM g)
SELECT type, a, b FROM d WHERE met > 0 AND digits = 0 AND ((contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 2 OR levenshtein(lower(a), lower(b)) <= least(length(a), length(b)) // 2)""")  # fmt: skip
def entity_candidates(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    return G.candidate_pairs(n)


@query("entity_resolution", """
SELECT 's' || s_suppkey AS src, 'in' AS relation, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'of', 'r' || n_regionkey FROM nation
UNION SELECT 's' || s_suppkey, 'sells in', 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def entity_resolution(spark, sf_dir):
    """Each supplier under its long name and its short one, confirmed to be one: edges of the long names go to the short ones."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    short, long = (F.concat(F.lit(p), F.col("s_suppkey").cast("string")) for p in ("s", "supplier "))
    far = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(long.alias("src"), F.lit("sells in").alias("relation"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    e = edges(spark, sf_dir).unionByName(far)
    v = e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
    return G.resolved_entities(v, e, s.select(long.alias("a"), short.alias("b")))[2]


@query("bounded_communities")
def bounded_communities(spark, sf_dir):
    """Communities of at most fifteen nodes by modularity, in rounds; tested against a sequential run."""
    return G.communities(edges(spark, sf_dir), most=G.COMMUNITY_SIZE).select("community_id", F.size("members").cast("bigint").alias("n"))


@query("orphan_cleanup", """
WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_orderkey % 20 NOT IN (1, 2, 3, 5, 8, 13))
SELECT 'supplier' AS kind, count(DISTINCT s) AS n FROM l UNION ALL SELECT 'part', count(DISTINCT p) FROM l""")  # fmt: skip
def orphan_cleanup(spark, sf_dir):
    t = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf_dir, "lineitem").select(t("s", "l_suppkey").alias("src"), t("p", "l_partkey").alias("dst"), (F.col("l_orderkey") % 20).alias("file_id"))
    v = e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
    gone = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 13)], "file_id bigint")
    left = G.without_file(e, v, gone)[1]
    return left.groupBy(F.when(F.col("name").startswith("s"), "supplier").otherwise("part").alias("kind")).agg(F.count("*").alias("n"))


@query("graph_stats", f"WITH {EDGES} SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e)) AS n_nodes, count(*) AS n_edges, count(*) * 2 AS n_seen FROM e")
def graph_stats(spark, sf_dir):
    return G.statistics(edges(spark, sf_dir))


@query("entities_by_word", "SELECT n_name AS word, c_name AS name FROM customer JOIN (SELECT right('0' || n_nationkey::VARCHAR, 2) AS n_name FROM nation) ON contains(c_name, n_name)")
def entities_by_word(spark, sf_dir):
    words = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("word"))
    return G.entities_holding(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), words)


@query("best_title_match", """
WITH w AS (SELECT n_nationkey AS wanted_id, n_name AS a FROM nation), h AS (SELECT s_suppkey AS have_id, s_name AS b FROM supplier UNION ALL SELECT 1000000000 + n_nationkey, n_name || ' table' FROM nation),
g AS (SELECT *, len(list_intersect(list_distinct([substr(a, i, 2) FOR i IN range(1, greatest(length(a), 2))]), list_distinct([substr(b, i, 2) FOR i IN range(1, greatest(length(b), 2))]))) AS shared FROM w, h)
SELECT wanted_id, have_id, shared::BIGINT AS shared FROM g WHERE shared >= 1 QUALIFY row_number() OVER (PARTITION BY wanted_id ORDER BY shared DESC, abs(length(a) - length(b)), have_id) = 1""")  # fmt: skip
def best_title_match(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    have = s.select(F.col("s_suppkey").cast("bigint").alias("have_id"), F.col("s_name").alias("title"))
    have = have.unionByName(n.select((F.col("n_nationkey") + 1_000_000_000).cast("bigint").alias("have_id"), F.concat("n_name", F.lit(" table")).alias("title")))
    return R.best_titles(n.select(F.col("n_nationkey").alias("wanted_id"), F.col("n_name").alias("title")), have)
