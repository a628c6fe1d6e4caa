"""An inverted-file index of vectors: cells around centroids, of which a search looks at the nearest ones.

Centroids are fitted on at most SAMPLE vectors (those of the lowest hashes of their ids), by rounds of assignment and means of
unit vectors; every vector of the table is then assigned to its nearest centroid and written by cell. A search reads the files of
the cells that its queries probe, and in a cell only the queries that probe it are scored. How many cells to probe is
measured: probes are raised until the share of the true first k that is found, over at most CALIBRATED queries, reaches the
target; search.dense_search gives the truth, and stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.operators.search import dense_search, in_blocks, top_k
from brindle.session import scratch

SAMPLE, CALIBRATED = 20_000, 200
ROUNDS, MOST_CELLS = 12, 1024
SEED = 7


@dataclass
class VectorIndex:
    """Where the cells lie, their centroids, and how many of them a search probes."""

    spark: SparkSession
    path: str
    item: str
    kind: str  # the item's type
    centroids: np.ndarray
    probes: int = 1
    recall: float = 0.0

    def rows(self, cells: list[int]) -> DataFrame:
        """(item, v, cell) of some cells, from their files alone."""
        return self.spark.read.schema(f"`{self.item}` {self.kind}, v array<double>, cell int").parquet(self.path).filter(F.col("cell").isin(cells))


def usable(vector, size: int | None = None):
    """Whether a vector can be compared: of the size, if one is given, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & ((F.size(vector) == size) if size else (F.size(vector) > 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a sample; one that no vector is nearest to begins again at the vector that is farthest from its own."""
    rng = np.random.default_rng(SEED)
    c = _unit(sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)])
    for _ in range(rounds):
        scores = sample @ c.T
        near = scores.argmax(axis=1)
        far = np.argsort(scores.max(axis=1), kind="stable")
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        sums[empty] = sample[far[: len(empty)]]
        c = _unit(sums)
    return c


def build_vector_index(items: DataFrame, item: str = "item_id", vector: str = "embedding", cells: int | None = None, path: str | None = None) -> VectorIndex:
    """Write every vector of a table by its cell. Vectors that can't be compared, or are of another size than most, are left out."""
    spark = items.sparkSession
    path = path or scratch(spark, "vector-index")
    d = items.select(item, F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    size = d.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    kind = items.schema[item].dataType.simpleString()
    if size is None:
        d.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(path)
        return VectorIndex(spark, path, item, kind, np.zeros((0, 1)))
    d = d.filter(F.size("v") == size["size"])
    taken = d.orderBy(F.xxhash64(F.col(item).cast("string")), item).limit(SAMPLE).select("v").collect()
    sample = _unit(np.array([r[0] for r in taken], float))
    centroids = fitted(sample, cells or int(min(MOST_CELLS, max(1, np.sqrt(size["count"])))))
    sent = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = (x @ c.T).argmax(axis=1) if batch.num_rows else np.array([], int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=[item, "v", "cell"])

    found = d.mapInArrow(assign, f"`{item}` {kind}, v array<double>, cell int")
    # A crowded cell is dealt over some files.
    found.repartition("cell", F.pmod(F.xxhash64(item), F.lit(4))).write.partitionBy("cell").parquet(path)
    return VectorIndex(spark, path, item, kind, centroids)


def probed_search(queries: DataFrame, index: VectorIndex, k: int, query: str = "query_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query, item, score, rank0): the k nearest items in the cells probed, by dot product of unit vectors, rounded to 12 places.
    Queries are a stated set, sent in blocks."""
    probes = max(1, min(probes or index.probes, len(index.centroids)))
    kind, item = to_arrow_type(queries.schema[query].dataType), index.item
    names = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{item}` {index.kind}, score double"

    def block(q: DataFrame) -> DataFrame:
        rows = q.collect() if len(index.centroids) else []  # bounded by in_blocks
        asked = np.array([r[1] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 1))
        cells = np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable")[:, :probes] if len(rows) and len(index.centroids) else np.zeros((0, 1), int)
        of_cell = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
        sent = q.sparkSession.sparkContext.broadcast(([r[0] for r in rows], asked, of_cell))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, wanted = sent.value
            ids = pa.array(ids, kind)
            for batch in batches:
                at = batch.column(2).to_numpy()
                for cell in np.unique(at).tolist():
                    rows_of, asking = np.flatnonzero(at == cell), wanted[cell]
                    part = batch.take(pa.array(rows_of))
                    x = part.column(1).flatten().to_numpy().reshape(len(rows_of), -1)
                    scores = np.round(x @ matrix[asking].T, 12)
                    bound = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else scores.min(axis=0)
                    i, j = np.nonzero(scores >= bound)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(asking[j])), part.column(0).take(pa.array(i)), pa.array(scores[i, j])], names=[query, item, "score"])

        found = index.rows(sorted(of_cell)) if of_cell else index.rows([-1])
        return top_k(found.mapInArrow(score, names), query, k, F.desc("score"), F.asc(item))

    size = index.centroids.shape[1] if len(index.centroids) else None
    return in_blocks(queries.select(query, F.col(vector).cast("array<double>").alias("qv")).filter(usable(F.col("qv"), size)), block, query)


def calibrated(index: VectorIndex, items: DataFrame, k: int = 10, target: float = 0.95, vector: str = "embedding") -> VectorIndex:
    """The index with as many probes as the recall of the first k takes, over at most CALIBRATED of its own items as queries."""
    q = items.filter(usable(F.col(vector).cast("array<double>"), index.centroids.shape[1])).orderBy(F.xxhash64(F.lit(SEED), F.col(index.item).cast("string")), index.item).limit(CALIBRATED)
    q = q.select(F.col(index.item).alias("query_id"), vector)
    true = {(r[0], r[1]) for r in dense_search(q, items, k, item=index.item, vector=vector).select("query_id", index.item).collect()}  # k rows of each
    probes = 1
    while True:
        found = {(r[0], r[1]) for r in probed_search(q, index, k, vector=vector, probes=probes).select("query_id", index.item).collect()}
        index.probes, index.recall = probes, len(found & true) / max(1, len(true))
        if index.recall >= target or probes >= len(index.centroids):
            return index
        probes = min(len(index.centroids), max(probes + 1, int(probes * 1.5)))
