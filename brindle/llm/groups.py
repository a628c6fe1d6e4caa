"""Groups of rows in sorted Arrow batches, comparison of members of a group, and dealing large groups out in cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of the rows of each key, from batches sorted by a key column without nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def dealt(df: DataFrame, group: str, members: str, member: str, per_block: int) -> DataFrame:
    """df with columns cell, block, blocks, low and high (the cell's two blocks): a group of at most per_block members is one cell; a
    larger one is cut into blocks, and each pair of blocks is a cell, so that every pair of members
    meets in a cell and no cell is larger than two blocks. A member goes to as many cells as there
    are blocks."""
    df = df.withColumn("blocks", F.ceil(F.col(members) / per_block).cast("int"))
    df = df.withColumn("block", F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return df.withColumn("cell", F.xxhash64(F.col(group), "low", "high")).drop("other")


def in_cells(df: DataFrame, function: Callable, schema: str, key: str = "cell", *then: str) -> DataFrame:
    """function over Arrow batches in which rows of a cell follow each other."""
    return df.repartition(key).sortWithinPartitions(key, *then).mapInArrow(tidied(function), schema)


def recurring(df: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key, a number without nulls, occurs in another row too. Rows are dealt once and sorted by that number alone; a task holds
    one row beside its batch, however often a key occurs."""
    at = df.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the last key, and its row if that was not told
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy()
            again = np.zeros(len(keys), bool)
            again[1:] = keys[1:] == keys[:-1]
            again[:-1] |= again[1:]
            if before == keys[0]:
                again[0] = True
                if held is not None:
                    yield held
            if again.any():
                yield batch.filter(pa.array(again))
            before, held = int(keys[-1]), None if again[-1] else batch.slice(len(keys) - 1)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(tidied(keep), df.schema)


def tidied(function: Callable) -> Callable:
    """function over Arrow batches that gives unused memory of the worker back when its task ends: workers live on, beside
    the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on 0..n-1. near(i, others) says which others are linked to i.
    Members that have been reached are not compared again, so a dense group costs little more than its size."""
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                new = left[hit].tolist()
                out += [(i, j) for j in new]
                queue += new
                left = left[~hit]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all pairs of sets, by products of incidence matrices over the shared elements."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    sizes = np.array([len(s) for s in sets])
    np.fill_diagonal(out, sizes)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    number = np.cumsum(count > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    products = np.zeros((n, n), np.float32)
    width = max(64, min(4096, (8 << 20) // max(1, n)))
    for k in range(0, total, width):
        a, b = np.searchsorted(column, (k, k + width))
        dense = np.zeros((n, width), np.float32)
        dense[owner[a:b], column[a:b] - k] = 1
        part = dense @ dense.T  # exact: counts of a chunk are far below 2**24
        products = part if k == 0 and total <= width else products + part
        if k and not k % (width * 1024):
            out += products.astype(np.int64)
            products[:] = 0
    if total:
        off = products.astype(np.int64) if total <= width * 1024 else out + products.astype(np.int64)
        np.fill_diagonal(off, sizes)
        return off
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least the threshold; False on the diagonal."""
    both = intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


