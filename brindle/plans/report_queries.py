"""Operational analytics over events, orders and conversations: activity, progress, caches, access and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import relational as R
from brindle.operators.search import top_k
from brindle.plans.registry import query
from brindle.session import table
from brindle.sources import sinks
from brindle.streaming import monitors as M


def last_moment(events):
    """The latest time of a table, as the moment that reports are made at: one value."""
    return F.lit(events.agg(F.max("ts")).first()[0])


@query("user_activity", """
SELECT user_id, count(*) AS n, max(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN ts END) AS last_first_type, max(ts) AS last_active FROM events GROUP BY user_id""")
def user_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first_type"))
    e = e.join(F.broadcast(first))  # a single value
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == F.col("first_type"), F.col("ts"))).alias("last_first_type"), F.max("ts").alias("last_active"))


@query("action_counts", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def action_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("activity_log_page", """
SELECT event_id, ts, coalesce(c_name, 'system') AS name FROM events LEFT JOIN customer ON user_id = c_custkey ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40""")
def activity_log_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    d = R.looked_up(table(spark, sf_dir, "events"), c, "user_id", "name", "system")
    return d.select("event_id", "ts", "name").orderBy(F.desc("ts"), "event_id").offset(40).limit(20)


@query("newest_reversed", "SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30) ORDER BY ts, event_id")
def newest_reversed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).orderBy("ts", "event_id")


@query("deleted_users", """
SELECT coalesce(c_name, 'deleted user') AS name, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 <> 0 GROUP BY 1""")
def deleted_users(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return R.looked_up(table(spark, sf_dir, "events"), c, "user_id", "name", "deleted user").groupBy("name").agg(F.count("*").alias("n"))


@query("metric_snapshots_10m", """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def metric_snapshots_10m(spark, sf_dir):
    d = M.snapshots(table(spark, sf_dir, "events"))
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("retention_30d", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def retention_30d(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.retained(e, "ts", last_moment(e)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("presence_changes", """
WITH e AS (SELECT event_type, user_id, ts, max(ts) OVER () AS until FROM events),
g AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM e WHERE ts < until WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts))
SELECT event_type, user_id, epoch_us(ts) AS at_us, 'joined' AS change FROM g WHERE before IS NULL OR ts - before > INTERVAL 1 DAY
UNION ALL SELECT event_type, user_id, epoch_us(ts + INTERVAL 1 DAY), 'left' FROM g WHERE (after IS NULL OR after - ts > INTERVAL 1 DAY) AND ts + INTERVAL 1 DAY < until""")
def presence_changes(spark, sf_dir):
    """Users that join and leave each kind of event, away after a day; the batch twin of the stream."""
    d = M.presence_changes(table(spark, sf_dir, "events"), ("event_type", "user_id"), seconds=86_400)
    return d.select("event_type", "user_id", F.unix_micros("at").alias("at_us"), "change")


@query("presence_active", """
SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) < 86401 * 1000000::BIGINT""")
def presence_active(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.presence(e, last_moment(e), seconds=86_400)


@query("visit_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS beats FROM s GROUP BY user_id, k""")  # fmt: skip
def visit_sessions(spark, sf_dir):
    d = M.visits(table(spark, sf_dir, "events"), gap="1 hour")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "beats")


@query("ttl_cache_hits", """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM (
  SELECT event_type, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) < 3601 * 1000000::BIGINT, false) AS hit FROM events) GROUP BY 1""")  # fmt: skip
def ttl_cache_hits(spark, sf_dir):
    d = R.ttl_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600)
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("one_pass_aggregate", "SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def one_pass_aggregate(spark, sf_dir):
    return M.one_pass(table(spark, sf_dir, "events"), "event_type", "value")


def job_status():
    return F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")


JOBS_SQL = "SELECT *, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders"


@query("progress_rollup", f"""
WITH g AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
                  count(*) FILTER (WHERE status = 'running') AS running, max(o_orderdate) AS updated_at FROM ({JOBS_SQL}) GROUP BY 1)
SELECT *, round(done / total * 100, 2) AS percent,
       CASE WHEN running > 0 THEN 'running' WHEN done = total THEN 'done' WHEN failed > 0 THEN 'partial' ELSE 'waiting' END AS state FROM g""")  # fmt: skip
def progress_rollup(spark, sf_dir):
    return R.rolled_up(table(spark, sf_dir, "orders").withColumn("status", job_status()), ["o_custkey"], "status", "o_orderdate")


@query("global_rollup", f"""
WITH g AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done FROM ({JOBS_SQL}) GROUP BY 1)
SELECT count(*) AS projects, sum(total)::BIGINT AS total, sum(done)::BIGINT AS done, round(CASE WHEN sum(total) = 0 THEN 100 ELSE sum(done) / sum(total) * 100 END, 2) AS percent FROM g""")  # fmt: skip
def global_rollup(spark, sf_dir):
    g = R.rolled_up(table(spark, sf_dir, "orders").withColumn("status", job_status()), ["o_custkey"], "status", "o_orderdate")
    a = g.agg(F.count("*").alias("projects"), F.sum("total").alias("total"), F.sum("done").alias("done"))
    return a.withColumn("percent", F.when(F.coalesce("total", F.lit(0)) == 0, 100.0).otherwise(F.round(F.col("done") / F.col("total") * 100, 2)))


@query("mode_progress", """
SELECT o_orderpriority AS mode, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 100, 2) AS percent FROM orders GROUP BY 1""")
def mode_progress(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode"))
    return g.agg(F.count("*").alias("n"), F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*") * 100, 2).alias("percent"))


@query("judge_daily_avg", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, value / 100 AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 50 END AS b, 1 - value / 100 AS c FROM events)
SELECT day, count(*) AS n, round(avg(greatest(0.0, least(1.0, coalesce(a, 0.5)))), 6) AS context_relevance, round(avg(greatest(0.0, least(1.0, coalesce(b, 0.5)))), 6) AS groundedness,
       round(avg(greatest(0.0, least(1.0, coalesce(c, 0.5)))), 6) AS answer_relevance FROM s GROUP BY 1""")  # fmt: skip
def judge_daily_avg(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", (F.col("value") / 100).alias("context_relevance"), F.when(F.col("event_id") % 3 == 0, "none").otherwise((F.col("value") / 50).cast("string")).alias("groundedness"), (1 - F.col("value") / 100).alias("answer_relevance"))
    return R.daily_scores(e, "ts")


@query("daily_upsert", """
WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT * FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT * FROM b""")  # fmt: skip
def daily_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    daily = lambda d: d.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return sinks.merged_daily(daily(e.filter("event_id % 2 = 0")), daily(e.filter("event_id % 3 = 0")))


@query("latest_version_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_version_per_key(spark, sf_dir):
    d = R.latest(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return d.select("o_custkey", "o_orderkey", "o_totalprice")


@query("batched_upsert", """
WITH s AS (SELECT s_suppkey AS id, s_name AS name, 0::BIGINT AS version FROM supplier),
n AS (SELECT s_suppkey AS id, 'new ' || s_name AS name, 1::BIGINT AS version FROM supplier WHERE s_suppkey % 4 = 0)
SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)""")  # fmt: skip
def batched_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).cast("bigint").alias("version"))
    new = s.filter("id % 4 = 0")
    twice = new.withColumn("name", F.lit("first")).unionByName(new.withColumn("name", F.concat(F.lit("new "), "name")).withColumn("version", F.lit(1).cast("bigint")))
    return sinks.upserted(s, twice, "id")


@query("cascade_delete", """
SELECT 'orders' AS store, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0""")
def cascade_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    left = sinks.cascade({"orders": o, "lineitem": table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")}, o.filter("k % 7 = 0").select("k"), "k")
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("store"), "n")
    return count("orders").unionByName(count("lineitem"))


@query("access_matrix", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 OR c_mktsegment = 'BUILDING' THEN 'rw' WHEN c_acctbal > 0 THEN 'r' ELSE 'none' END AS access FROM customer""")
def access_matrix(spark, sf_dir):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user")
    seen = F.when(F.col("c_acctbal") > 0, "public").otherwise("private")
    return table(spark, sf_dir, "customer").select("c_custkey", R.access(F.lit(3), role, F.col("c_nationkey"), seen).alias("access"))


@query("payload_filter", """
SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src1' AND (n_chars IS NULL OR n_chars <> 0)""")
def payload_filter(spark, sf_dir):
    return R.matching(table(spark, sf_dir, "documents"), {"lang": ["en", "de"], "source": "src1"}, {"n_chars": 0}).select("doc_id")


@query("stale_tasks", """
SELECT event_type, count(*) AS n FROM events WHERE date_diff('microsecond', ts, (SELECT max(ts) FROM events)) >= 1801 * 1000000::BIGINT GROUP BY 1""")
def stale_tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter(R.stale(F.col("ts"), last_moment(e))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("retryable_faults", """
SELECT event_id FROM events WHERE user_id % 2 = 0 AND regexp_matches(lower(event_type), 'click|view') AND event_id % 5 < 3""")
def retryable_faults(spark, sf_dir):
    status = F.when(F.col("user_id") % 2 == 0, "failed").otherwise("done")
    return table(spark, sf_dir, "events").filter(R.retryable(status, F.col("event_type"), F.col("event_id") % 5, ("click", "view"))).select("event_id")


@query("admission_routes", """
SELECT CASE WHEN n_chars * 100000 > 1610612736 THEN 'too_large' WHEN source IN ('src0', 'src1') THEN 'unsupported_format'
            WHEN n_chars * 100000 > 2097152 OR (source = 'src2' AND n_chars * 100000 > 1048576) THEN 'slow' ELSE 'fast' END AS queue, count(*) AS n
FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")  # fmt: skip
def admission_routes(spark, sf_dir):
    kind = F.when(F.col("source").isin("src0", "src1"), "exe").when(F.col("source") == "src2", "xlsx").otherwise("txt")
    d = table(spark, sf_dir, "documents").filter("n_chars is not null")
    files = d.select((F.col("n_chars") * 100_000).alias("size"), F.concat(F.lit("f."), kind).alias("name"))
    return M.routed(files).groupBy("queue").agg(F.count("*").alias("n"))


@query("ghost_ids", """
SELECT DISTINCT doc_id, 'labels' AS store FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)
UNION ALL SELECT DISTINCT vec_id, 'vectors' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)""")  # fmt: skip
def ghost_ids(spark, sf_dir):
    real = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0")
    stores = {"labels": table(spark, sf_dir, "labels"), "vectors": table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")}
    return R.ghosts(stores, real, "doc_id")


@query("case_public_split", """
SELECT (doc_id IN (SELECT doc_id FROM labels)) AS is_case, count(*) AS n FROM documents GROUP BY 1""")
def case_public_split(spark, sf_dir):
    case, public = R.split_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    count = lambda d, flag: d.agg(F.count("*").alias("n")).select(F.lit(flag).alias("is_case"), "n")
    return count(case, True).unionByName(count(public, False))


@query("three_level_lookup", """
SELECT d.doc_id, coalesce(l.v, e.v, p.v) AS v, CASE WHEN l.v IS NOT NULL THEN 0 WHEN e.v IS NOT NULL THEN 1 WHEN p.v IS NOT NULL THEN 2 END AS level
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, min(quality)::BIGINT AS v FROM labels GROUP BY 1) l USING (doc_id)
LEFT JOIN (SELECT vec_id AS doc_id, min(label)::BIGINT AS v FROM embeddings GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT page_id AS doc_id, min(length(url))::BIGINT AS v FROM pages GROUP BY 1) p USING (doc_id)""")  # fmt: skip
def three_level_lookup(spark, sf_dir):
    value = lambda name, key, v: table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), v.cast("bigint").alias("v"))
    sources = [value("labels", "doc_id", F.col("quality")), value("embeddings", "vec_id", F.col("label")), value("pages", "page_id", F.length("url"))]
    return R.first_hit(table(spark, sf_dir, "documents").select("doc_id").distinct(), sources, "doc_id", "v")


@query("reference_expansion", """
SELECT DISTINCT n_nationkey AS ref_id, n_regionkey AS library, s_suppkey AS file_id FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey
WHERE n_nationkey % 2 = 0 OR s_suppkey IN (n_nationkey, n_nationkey + 1)""")  # fmt: skip
def reference_expansion(spark, sf_dir):
    ids = F.when(F.col("n_nationkey") % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("n_nationkey").cast("bigint"), (F.col("n_nationkey") + 1).cast("bigint")))
    refs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref_id"), F.col("n_regionkey").alias("library"), ids.alias("file_ids"))
    files = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("library"), F.col("s_suppkey").alias("file_id"))
    return R.references(refs, files)


@query("project_references", """
SELECT n_nationkey AS ref_id, s_suppkey FROM nation JOIN supplier ON list_contains([n_nationkey, n_nationkey + 1], s_suppkey)""")
def project_references(spark, sf_dir):
    refs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref_id"), F.explode(F.array(F.col("n_nationkey").cast("bigint"), F.col("n_nationkey").cast("bigint") + 1)).alias("s_suppkey"))
    return refs.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("ref_id", "s_suppkey")


@query("deleted_message_pairs", """
WITH o AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS id, lead(role) OVER w AS nr, lead(conv_id * 1000 + turn) OVER w AS nk, lag(role) OVER w AS pr, lag(conv_id * 1000 + turn) OVER w AS pk
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT id, conv_id, role, CASE WHEN role = 'user' AND nr = 'assistant' THEN nk WHEN role = 'assistant' AND pr = 'user' THEN pk END AS partner FROM o WHERE turn % 3 = 0""")  # fmt: skip
def deleted_message_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return R.deleted_pairs(c, c.filter("turn % 3 <> 0"), "id", "turn", "conv_id")


@query("consecutive_failures", """
WITH f AS (SELECT user_id, event_id, (value > 50) AS failed FROM events),
g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM f),
s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g),
h AS (SELECT *, max((streak >= 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM s)
SELECT user_id, event_id, streak::BIGINT AS streak FROM h WHERE coalesce(hit, 0) = 0""")  # fmt: skip
def consecutive_failures(spark, sf_dir):
    d = R.until_failures(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 50)
    return d.select("user_id", "event_id", "streak")


@query("priority_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderdate DESC, o_orderkey)::BIGINT AS place FROM orders WHERE o_orderstatus = 'P' QUALIFY place <= 100""")
def priority_order(spark, sf_dir):
    d = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumn("all", F.lit(1))
    top = d.orderBy(F.substring("o_orderpriority", 1, 1).cast("int"), F.desc("o_orderdate"), "o_orderkey").limit(100)
    return top_k(top, "all", 100, F.substring("o_orderpriority", 1, 1).cast("int").asc(), F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", (F.col("rank0") + 1).alias("place"))


@query("queue_lengths", """
SELECT event_type AS queue, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS waiting, sum((value > 50)::INT)::BIGINT AS active FROM events GROUP BY ALL""")
def queue_lengths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("queue"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("waiting"), F.sum((F.col("value") > 50).cast("int")).alias("active"))


@query("random_sample")
def random_sample(spark, sf_dir):
    """A seeded sample of 500 at most, a sampling operator."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy(F.rand(42), "vec_id").limit(500)
