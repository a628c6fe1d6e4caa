"""What operators send, shuffle and make on larger tables, read off plans and counts of rows on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import pivot_join as P
from brindle.operators import search as S
from brindle.session import stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_not_sent_to_all_tasks(spark):
    names = spark.range(30_000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    words = spark.range(25).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("word"))
    d = G.entities_holding(names, words)
    want = {(f"{w:02}", f"Customer#{n:09}") for n in range(30_000) for w in range(25) if f"{w:02}" in f"{n:09}"}
    rows = [tuple(r) for r in d.collect()]
    assert len(rows) == len(want) and set(rows) == want
    joins = [line for line in plan_of(d).split("Initial Plan")[0].split("\n") if "Join" in line]  # as they ran
    assert joins and not any("BuildLeft" in line for line in joins)


@pytest.mark.parametrize("dense,signs", [(1024, (1,)), (3, (1,)), (3, (1, -1, 0)), (1024, (1, -1, 0))])
def test_sparse_vectors_make_no_row_for_each_pair(spark, monkeypatch, dense, signs):
    monkeypatch.setattr(S, "DENSE_TOKENS", dense)
    monkeypatch.setattr(S, "SCORES_AT_ONCE", 60)
    rng = random.Random(dense)
    made = lambda n, most: [(k, f"t{rng.randrange(most)}", rng.choice(signs) * rng.randrange(1, 9) / 2) for k in range(n) for _ in range(rng.randrange(5))]
    q, v = made(20, 14), made(150, 12)
    got = S.sparse_dot(spark.createDataFrame(q + [(3, None, 1.0)], "query_id int, token string, weight double"), spark.createDataFrame(v + [(4, None, 1.0), (5, "t1", None)], "key long, token string, weight double"), 4)
    assert "Join" not in plan_of(got)
    score = {}
    for a, t, x in q:
        for b, u, y in v:
            if t == u:
                score[a, b] = score.get((a, b), 0.0) + x * y
    want = [(a, b, x, r) for a in range(20) for r, (x, b) in enumerate(sorted(((x, b) for (c, b), x in score.items() if c == a), key=lambda z: (-z[0], z[1]))[:4])]
    assert sorted((r.query_id, r.key, r.score, r.rank0) for r in got.collect()) == sorted(want)


def test_ranked_paths_over_a_hub_keep_few_rows(spark, monkeypatch):
    made, keep = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: made.append(keep(df)) or made[-1])
    leaves, k = 200, 4
    edges = spark.range(leaves).select(F.format_string("s%03d", "id").alias("src"), F.lit("in").alias("relation"), F.lit("hub").alias("dst"))
    edges = edges.union(spark.createDataFrame([("hub", "of", "top")], "src string, relation string, dst string"))
    ranks = spark.createDataFrame([("hub", 9.0), ("top", 5.0)], "node string, pagerank double").union(spark.range(leaves).select(F.format_string("s%03d", "id"), F.lit(1.0)))
    got = sorted(tuple(r) for r in G.ranked_paths(edges, edges.filter("src <> 'hub'").select(F.col("src").alias("seed")), ranks, 3, k).select("seed", "rank0", "nodes").collect())
    want = []
    for s in (f"s{i:03}" for i in range(leaves)):
        others = [x for x in ("s000", "s001", "s002") if x != s][:2]
        want += [(s, r, n) for r, n in enumerate([[s, "hub"], [s, "hub", "top"], *([s, "hub", x] for x in others)])]
    assert got == want
    assert max(d.count() for d in made) <= leaves * (k + 3)  # a row for each pair of leaves would be 39,800


def test_paths_that_end_are_not_shuffled_again(spark, monkeypatch):
    made, keep = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(G, "EDGES_TOGETHER", 16)
    leaves = 90
    edges = spark.range(leaves).select(F.format_string("s%02d", "id").alias("src"), F.lit("in").alias("relation"), F.lit("hub").alias("dst"))
    edges = edges.union(spark.createDataFrame([("hub", "of", "top"), ("top", None, "end"), ("end", "r", "end")], "src string, relation string, dst string"))
    d = G.all_paths(edges, spark.range(leaves).select(F.format_string("s%02d", "id").alias("seed")), 3)
    assert "BroadcastExchange" not in plan_of(d)
    got = d.withColumn("text", G.rendered(F.col("nodes"), F.col("relations"))).collect()
    want = [[f"s{a:02}", "hub"] for a in range(leaves)] + [[f"s{a:02}", "hub", "top"] for a in range(leaves)] + [[f"s{a:02}", "hub", "top", "end"] for a in range(leaves)]
    want += [[f"s{a:02}", "hub", f"s{b:02}"] for a in range(leaves) for b in range(leaves) if a != b]
    assert sorted(r.nodes for r in got) == sorted(want) and all(r.text == r.path for r in got)
    assert max(x.count() for x in made) < 3 * leaves


def test_many_rows_in_few_packed_bytes_are_not_small(spark):
    rows = stored(spark.range(1_000_000).select((F.col("id") % 7).alias("k"), F.lit("the same words in every row").alias("text")))
    assert S.stored_bytes(rows) <= S.BROADCAST_BYTES // 8
    some = spark.createDataFrame([(1,)], "k long")
    assert "BroadcastExchange" not in plan_of(some.join(S.small(rows), "k"))
    assert "BroadcastExchange" not in plan_of(some.join(S.small(rows.filter("k > 2"), part_of=rows), "k"))
    assert "BroadcastExchange" in plan_of(some.join(S.small(stored(some)), "k"))


@pytest.mark.parametrize("least,scale", [(0.96, 1.0), (0.2, 1.0), (-0.1, 1.0), (0.5, 1e-8)])
def test_vectors_are_not_written_for_each_partner(spark, monkeypatch, least, scale):
    monkeypatch.setattr(P, "PANEL", 16)
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, x[:40], x[:40]]) * np.sqrt(scale)
    rows = [(k, k // 2, "all" if k % 5 else f"s{k % 3}", x[k].tolist()) for k in range(len(x))]
    got = P.cached_answers(spark.createDataFrame(rows, "vec_id int, ts int, scope string, embedding array<double>"), least * scale)
    assert "CartesianProduct" in plan_of(got) and "BroadcastNestedLoopJoin" not in plan_of(got)
    want = []
    for i, t, s, v in rows:
        found = [(-round(float(np.dot(v, w)), 12), j) for j, u, z, w in rows if z == s and u < t]
        want += [(i, min(found)[1], -min(found)[0])] if found and -min(found)[0] >= least * scale else []
    assert sorted((a, b, round(c, 11)) for a, b, c in map(tuple, got.collect())) == [(a, b, round(c, 11)) for a, b, c in want] and want
