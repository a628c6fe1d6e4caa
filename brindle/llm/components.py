"""Connected components of an edge table by alternating large and small stars.

Each round links every vertex to the least one it can see; vertices and edges stay in tables, and
a round's edges are written to the shared folder. Rounds end when a round changes nothing. Only the
number of edges and a checksum of them reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.groups import tidied

LOCAL_EDGES = 1 << 20


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges of a task, a bounded number of edges at a time."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        r = v
        while parent.get(r, r) != r:
            r = parent[r]
        while parent.get(v, v) != r:
            parent[v], v = r, parent[v]
        return r

    def stars() -> pa.RecordBatch:
        rows = [(v, root(v)) for v in list(parent)]
        rows = [(v, r) for v, r in rows if v != r]
        parent.clear()
        a = np.array(rows, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > LOCAL_EDGES:
            yield stars()
    yield stars()


def _least(edges: DataFrame, u: str, v: str) -> DataFrame:
    return edges.groupBy(u).agg(F.min(v).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b: bigint); the component is its least vertex.
    Edges from a vertex to itself make a component of one. An empty table gives no rows."""
    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    current = written(pairs.mapInArrow(tidied(_local_forest), "a bigint, b bigint").distinct(), "edges")
    before = _state(current)
    while before[0]:
        # Large star: the larger neighbours of u (and u) are linked to the least vertex around u.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "a", "b").select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: u and its smaller neighbours are linked to the least of those.
        least = _least(large, "a", "b")
        small = large.join(least, "a").select(F.col("b").alias("v"), F.col("a"), F.col("m"))
        small = small.select(F.explode(F.array(F.col("v"), F.col("a"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        following = written(small, "edges")
        discard(current)
        current, state = following, _state(following)
        if state == before:
            break
        before = state
    found = current.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return r.n, r.h
