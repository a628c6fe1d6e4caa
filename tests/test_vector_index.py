"""The inverted file against all pairs: recall as calibrated, every row indexed, whole when all cells are probed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import search as S
from brindle.operators import vector_index as V
from brindle.session import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark):
    v = table(spark, SF, "embeddings").withColumnRenamed("vec_id", "item_id")
    return v, V.calibrated(V.build_vector_index(v), v)


def pairs(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


def test_every_row_is_in_one_cell(spark, index):
    v, ix = index
    rows = ix.rows(list(range(len(ix.centroids)))).select("item_id", "cell", "v").collect()
    assert sorted(r.item_id for r in rows) == sorted(r.item_id for r in v.select("item_id").collect())
    for r in rows[:50]:
        assert r.cell == int((ix.centroids @ np.array(r.v)).argmax())


def test_recall_holds_on_other_queries(spark, index):
    v, ix = index
    assert ix.recall >= 0.95 and ix.probes <= len(ix.centroids)
    q = v.filter("item_id % 7 = 3").select(F.col("item_id").alias("query_id"), "embedding")
    true = pairs(S.dense_search(q, v, 10))
    assert len(pairs(V.probed_search(q, ix, 10)) & true) >= 0.9 * len(true)
    # All cells probed: the exact rows, scores and ranks.
    full = sorted(map(tuple, V.probed_search(q, ix, 10, probes=10**6).collect()))
    assert full == sorted(map(tuple, S.dense_search(q, v, 10).collect()))


def test_grouped_vectors_need_few_probes(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 24))
    rows = [(i, (base[i % 30] + 0.2 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    v = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))))
    ix = V.calibrated(V.build_vector_index(v), v)
    assert ix.recall >= 0.95 and ix.probes <= len(ix.centroids) // 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    ix = V.build_vector_index(v, cells=2)
    got = V.probed_search(q, ix, 2, probes=2).collect()
    assert sorted((r.query_id, r.item_id) for r in got) == [(1, 1), (1, 2), (2, 2), (2, 7), (7, 2), (7, 7)]
    exact = S.dense_search(q.filter("query_id < 6"), v.filter("item_id <> 6"), 2).collect()
    assert sorted((r.query_id, r.item_id) for r in exact) == [(1, 1), (1, 2), (2, 2), (2, 7), (5, 5)]
    empty = v.filter("item_id < 0")
    assert V.probed_search(q, V.build_vector_index(empty), 2).collect() == []
