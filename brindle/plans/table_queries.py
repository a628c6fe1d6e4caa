"""Exact table analytics: the idioms of generated SQL through the guarded endpoint, and automatic profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import relational as R
from brindle.operators import tables as T
from brindle.plans.registry import query
from brindle.plans.sql_endpoint import run_sql
from brindle.session import register_tables, scratch, table
from brindle.sources.attribute_tables import AttributeTables

# Each is run as it stands by both engines.
IDIOMS = {
    "cond_agg_by_flag": ("lineitem", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted,
       round(sum(CASE WHEN l_quantity >= 25 THEN l_extendedprice ELSE 0 END), 2) AS big_price,
       round(avg(l_quantity), 4) AS avg_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus"""),
    "filtered_aggregates": ("orders", """
SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_final,
       CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS n_other, round(max(o_totalprice), 2) AS top_price
FROM orders GROUP BY o_orderpriority HAVING count(*) > 1"""),
    "quoted_identifiers": ("part", """
SELECT p_type AS "part type", round(avg(p_retailprice), 4) AS "mean price (each)" FROM part GROUP BY p_type"""),
    "text_cast": ("events", """
SELECT event_type, CAST(sum(CAST(CAST(user_id AS VARCHAR(20)) AS DOUBLE)) AS BIGINT) AS id_sum FROM events GROUP BY event_type"""),
    "totals_excluded": ("nation", """
SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation
WHERE CAST(n_name AS VARCHAR(60)) NOT LIKE '%UNITED%' GROUP BY n_regionkey"""),
    "merged_cell_dedup_sum_sql": ("orders lineitem", """
SELECT o_orderpriority, round(sum(price), 2) AS total
FROM (SELECT o_orderkey, o_orderpriority, min(o_totalprice) AS price
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority) t
GROUP BY o_orderpriority"""),
    "ties_at_max": ("part", """
SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)"""),
    "only_flag_orders": ("lineitem", """
SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N'
EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N' OR l_returnflag IS NULL"""),
    "exact_in": ("supplier nation", """
SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7')"""),
    "isolated_measures": ("orders lineitem", """
SELECT (SELECT round(sum(o_totalprice), 2) FROM orders) AS header_total,
       (SELECT round(sum(l_extendedprice), 2) FROM lineitem) AS detail_total"""),
    "union_of_sheets": ("customer supplier", """
SELECT kind, CAST(count(*) AS BIGINT) AS n, round(sum(balance), 2) AS balance
FROM (SELECT 'customer' AS kind, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'supplier' AS kind, s_acctbal AS balance FROM supplier) u GROUP BY kind"""),
    "star_join": ("customer orders nation region", """
SELECT r_name, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, o_orderstatus"""),
    "cube_of_flags": ("lineitem", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""),
    "rollup_of_priority": ("orders", """
SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"""),
    "running_total": ("orders", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place
FROM orders"""),
    "median_price": ("lineitem", """
SELECT l_returnflag, round(median(l_extendedprice), 4) AS mid, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag"""),
    "cte_query": ("orders customer", """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_nationkey, round(sum(total), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"""),
}


def _idiom(name: str, tables: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        register_tables(spark, sf_dir, tables.split())
        return run_sql(spark, sql)


for _name, (_tables, _sql) in IDIOMS.items():
    _idiom(_name, _tables, _sql)


@query("merged_cell_dedup_sum", """
SELECT o_orderpriority, round(sum(CASE WHEN lo = hi THEN lo ELSE s END), 2) AS total
FROM (SELECT o_orderpriority, o_orderkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_totalprice) AS s
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY ALL""")  # fmt: skip
def merged_cell_dedup_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = R.once_per_block(rows.select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", ["o_orderpriority"])
    return out.withColumn("total", F.round("total", 2))


@query("merged_column_detector", """
WITH j AS (SELECT o_custkey AS g, o_orderkey, o_totalprice, l_quantity, o_shippriority_ AS p FROM
             (SELECT *, 1.0 AS o_shippriority_ FROM orders) JOIN lineitem ON o_orderkey = l_orderkey),
u AS (SELECT o_orderkey AS g, 'o_totalprice' AS "column", o_totalprice AS value FROM j
      UNION ALL SELECT o_orderkey, 'l_quantity', l_quantity FROM j UNION ALL SELECT o_orderkey, 'flat', p FROM j),
per AS (SELECT "column", g, count(*) AS n, count(DISTINCT value) AS k FROM u GROUP BY ALL),
w AS (SELECT "column", count(DISTINCT value) AS n_distinct FROM u GROUP BY ALL),
f AS (SELECT "column", sum(n)::BIGINT AS n, avg((k = 1)::INT::DOUBLE) AS s FROM per GROUP BY ALL)
SELECT f."column", n, n_distinct, round(s, 6) AS single_share, (n >= 10 AND n_distinct / n < 0.3 AND s >= 0.9) AS merged
FROM f JOIN w ON f."column" = w."column" """)  # fmt: skip
def merged_column_detector(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.merged_columns(rows.withColumn("flat", F.lit(1.0)), ["o_totalprice", "l_quantity", "flat"], "o_orderkey")


PART_COLUMNS = ["p_name", "p_type", "p_size", "p_retailprice"]


@query("column_profile_numeric", """
WITH u AS (UNPIVOT (SELECT p_name::VARCHAR AS p_name, p_type::VARCHAR AS p_type, p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice FROM part)
           ON p_name, p_type, p_size, p_retailprice INTO NAME "column" VALUE value),
c AS (SELECT *, try_cast(value AS DOUBLE) AS number FROM u WHERE trim(value) NOT IN ('', '-', '—', '/')),
g AS (SELECT "column", count(*) AS filled, count(number) AS n, count(DISTINCT value) AS n_distinct, round(sum(number), 2) AS total,
             round(avg(number), 4) AS mean, min(number) AS least, max(number) AS most FROM c GROUP BY ALL)
SELECT * EXCLUDE (filled) FROM g WHERE n > filled * 0.5""")  # fmt: skip
def column_profile_numeric(spark, sf_dir):
    return R.profile_numeric(table(spark, sf_dir, "part"), PART_COLUMNS)


@query("column_profile_categorical_top10", """
WITH u AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL AND trim(value) NOT IN ('', '-', '—', '/') GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY "column") AS n_distinct, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM c)
SELECT * FROM r WHERE place <= 10""")  # fmt: skip
def column_profile_categorical_top10(spark, sf_dir):
    return R.profile_categories(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("auto_group_summary", """
WITH u AS (SELECT 'p_type' AS category, p_type AS value, p_retailprice AS m FROM part UNION ALL SELECT 'p_name', p_name, p_retailprice FROM part),
g AS (SELECT category, value, round(sum(m), 2) AS total, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, printf('%.2f', total) AS shown FROM g QUALIFY row_number() OVER (PARTITION BY category ORDER BY total DESC, value) <= 100""")  # fmt: skip
def auto_group_summary(spark, sf_dir):
    """Each of two categories on its own, largest sums first."""
    return R.auto_summary(table(spark, sf_dir, "part"), ["p_type", "p_name", "p_size"], "p_retailprice")


@query("schema_summary", """
WITH u AS (SELECT 's_suppkey' AS "column", s_suppkey::VARCHAR AS v FROM supplier UNION ALL SELECT 's_name', s_name FROM supplier
           UNION ALL SELECT 's_nationkey', s_nationkey::VARCHAR FROM supplier)
SELECT "column", CASE WHEN "column" = 's_name' THEN 'string' ELSE 'bigint' END AS type, count(*) AS n, count(v) AS filled, count(DISTINCT v) AS n_distinct FROM u GROUP BY 1""")  # fmt: skip
def schema_summary(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint"), "s_name", F.col("s_nationkey").cast("bigint"))
    return T.schema_summary(d)


@query("typed_columns", """
SELECT event_type AS a, try_cast(user_id AS DOUBLE) AS b, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def typed_columns(spark, sf_dir):
    d = T.typed(table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.col("user_id").cast("string").alias("b")))
    return d.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("cross_filter_total", """
WITH r AS (SELECT p_name, p_type, p_retailprice, p_size FROM part WHERE contains(p_name, '1') AND regexp_matches(p_type, 'STEEL|BRASS|TYPE'))
SELECT sum(CASE WHEN lo = hi THEN lo ELSE s END) AS total FROM (SELECT p_size, min(p_retailprice) AS lo, max(p_retailprice) AS hi, sum(p_retailprice) AS s FROM
  (SELECT * FROM r UNION ALL SELECT p_name, p_type, p_retailprice, p_size FROM part WHERE contains(p_name, '1') AND NOT EXISTS (SELECT 1 FROM r)) GROUP BY 1)""")  # fmt: skip
def cross_filter_total(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_name", "p_type", "p_retailprice", "p_size")
    return T.cross_filter(d, "p_name", ["1"], ["STEEL", "BRASS", "TYPE"], "p_retailprice", "p_size")


@query("attribute_table_ranges", """
SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS line, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag, l_tax > 0.04 AS taxed FROM lineitem""")
def attribute_table_ranges(spark, sf_dir):
    """Order lines written as attribute tables and read back by ranges of records, three columns left out of the records."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_tax") > 0.04).alias("taxed"),
    )
    spark.dataSource.register(AttributeTables)
    folder = scratch(spark, "attribute-tables")
    lines.write.format("attribute_tables").mode("append").save(folder)
    return spark.read.format("attribute_tables").option("columns", "orderkey,line,quantity,price,flag,taxed").option("records", 250_000).load(folder).drop("path", "record")


@query("attribute_table_summary", """
SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS area, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""")
def attribute_table_summary(spark, sf_dir):
    """Count, sum and bounds of a numeric field by a text field of attribute tables, of which only those two columns are cut out."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("area"), F.col("l_linestatus").alias("status"))
    spark.dataSource.register(AttributeTables)
    folder = scratch(spark, "attribute-tables")
    lines.write.format("attribute_tables").mode("append").save(folder)
    d = spark.read.format("attribute_tables").option("columns", "flag,area").load(folder)
    return d.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"), F.min("area").alias("least"), F.max("area").alias("most"))


@query("titles_one_to_one")
def titles_one_to_one(spark, sf_dir):
    """Parts of each brand matched one to one with tables named by part and type; a fold in order, so without SQL, tested against that fold."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "project_id")
    wanted = p.select("project_id", F.col("p_partkey").alias("wanted_id"), F.col("p_name").alias("title"))
    have = p.select("project_id", F.col("p_partkey").alias("have_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return T.matched_titles(wanted, have)
