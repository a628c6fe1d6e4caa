"""Near-duplicate vectors by collision-counting projections.

Vectors are scaled to length 1; equal ones are one node. A run sorts the nodes along a random projection and takes as
collisions the pairs of which one lies in the window around the other. A pair's collisions are counted over the runs, and the
pairs that reach the count are verified by their cosine in double precision. The number of runs is the least by which a pair
at the threshold reaches the count with the stated recall; closer pairs reach it more surely.

One projection alone is too weak for that: of two unit vectors at a cosine of 0.95 and two at a right angle the second pair is
but 4.5 times as far apart, so windows that hold the first hold a quarter of the second, and the collisions would
outnumber all pairs. Each run therefore sorts within the cells of `cuts` further projections, cut at random offsets, and cuts grow
with the logarithm of the number of nodes so that a node meets about MEETINGS others by chance in a run.

Groups of near copies are not expanded: nodes that lie within half the angle of the threshold around the mean of a crowded
cell are a ball, and any two of one ball are linked by the triangle inequality. Pairs within a ball are
counted at once and never made; all other links are found and verified as pairs. A cell of more nodes than BLOCK is dealt
out in blocks, of which each pair meets once; nodes of the cell's largest ball need not meet each other and only meet the rest.

Result: a row for each vector: vec_id, n_links (other vectors linked directly), component_id (the least vec_id that links
reach), kept (vec_id is component_id).

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are
components of their own; vectors of different sizes don't link; rows of equal vectors link with each other, whatever their ids;
rows without vec_id are counted as links, and a component's id is the least id that it has (null if none); kept is then
false; an empty table gives no rows; extra columns are not read. Node keys are 64-bit hashes of the scaled vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, cos, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.components import components
from brindle.llm.groups import grouped, in_cells, tidied
from brindle.llm.shingles import mixed

THRESHOLD, RECALL = 0.95, 0.999
COUNT = 2  # collisions by which a pair is verified
WIDTH, WINDOW = 2.0, 1.6  # of a cut in projections of unit vectors; of half a window, times the distance at the threshold
MEETINGS = 8  # nodes met by chance in a run
RUNS_AT_ONCE = 16
DENSE, BALL_RUNS, CENTRE_RUNS = 32, 4, 8  # nodes in a cell that may get a centre; runs whose cells give centres, and in which they are met
SPREAD, LONG_MEAN = 0.5, 0.7  # of a cell that may get a centre: most variance along the projection, least length of the mean
BLOCK = 2048
PAIRS_AT_ONCE = 1 << 20
SEED = 20_240_117
MARGIN = 1e-9  # radians


def _together(width: float, distance: float) -> float:
    """Chance that a cut at a random offset has the projections of two points at this distance in one cell."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def _within(window: float, distance: float) -> float:
    return erf(window / distance / sqrt(2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, count: int = COUNT) -> tuple[int, int, float]:
    """(cuts, runs, half window) for n nodes."""
    near, far = sqrt(2 - 2 * threshold), sqrt(2)
    window = WINDOW * near
    cuts = max(1, ceil(log(max(1.0, n * _within(window, far) / MEETINGS)) / -log(_together(WIDTH, far))))
    p = _together(WIDTH, near) ** cuts * _within(window, near)
    runs = count
    while sum(comb(runs, k) * p**k * (1 - p) ** (runs - k) for k in range(count)) > 1 - recall:
        runs += 1
    return cuts, runs, window


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """The vectors of a column scaled to length 1, as doubles; null for those that link with nothing."""
    column = column.cast(pa.large_list(pa.float64()))
    out: list[bytes | None] = [None] * len(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes[valid]).tolist():
        if not size:
            continue
        rows = np.flatnonzero(valid & (sizes == size))
        v = values[offsets[rows][:, None] + np.arange(size)]
        most = np.abs(v).max(axis=1)
        good = np.isfinite(v).all(axis=1) & (most > 0)
        v = v[good] / most[good][:, None]
        v = v / np.sqrt((v * v).sum(axis=1))[:, None] + 0.0
        for i, x in zip(rows[good].tolist(), v):
            out[i] = x.tobytes()
    return out


def nodes_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, node, unit) of each row; node and unit are null where the vector links with nothing."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_vectors(batch.column(1))
            keys = [None if u is None else int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(u)))) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(units, pa.binary())], names=["id", "node", "unit"])

    read = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>"))
    return read.mapInArrow(tidied(scale), "id bigint, node bigint, unit binary")


def _projections(size: int, cuts: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of a run's cuts and of its order (last), and the offsets of the cuts."""
    rng = np.random.default_rng([SEED, size, run])
    return rng.standard_normal((size, cuts + 1)), rng.uniform(0, WIDTH, cuts)


def projected(nodes: DataFrame, cuts: int, runs: range, also: tuple[str, ...] = ()) -> DataFrame:
    """(cell, value, node, *also) for each run. nodes: node, unit, and what goes along."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.array([len(u) // 8 for u in batch.column(1).to_pylist()])
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), float).reshape(-1, size)
                for run in runs:
                    if (size, run) not in known:
                        known[size, run] = _projections(size, cuts, run)
                    directions, offsets = known[size, run]
                    p = v @ directions
                    places = np.floor((p[:, :-1] + offsets) / WIDTH).astype(np.int64).view(np.uint64)
                    cell = mixed(np.full(len(v), size * 1_000_003 + run + 1, np.uint64))
                    with np.errstate(over="ignore"):
                        for k in range(cuts):
                            cell = mixed(cell * np.uint64(31) + places[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(p[:, -1].astype(np.float32)), part.column(0), *(part.column(2 + k) for k in range(len(also)))], names=["cell", "value", "node", *also])

    schema = "cell bigint, value float, node bigint" + "".join(f", {c} {kinds[c]}" for c in also)
    return nodes.select("node", "unit", *also).mapInArrow(tidied(project), schema)


def balls(nodes: DataFrame, cuts: int, threshold: float, dense: int = DENSE) -> DataFrame:
    """(node, ball): nodes within half the threshold's angle of a centre. Centres are the means of cells that mostly hold one group of
    near copies: of many nodes, little spread along the projection and a long mean. A node takes the centre of most nodes
    among those that it shares a cell with in some run, so that a group gathers around one."""
    cells = written(projected(nodes, cuts, range(BALL_RUNS)), "cells")
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n"), F.var_pop("value").alias("spread")).filter((F.col("n") >= dense) & (F.col("spread") <= SPREAD))
    members = written(cells.select("cell", "node").join(crowded.select("cell"), "cell", "left_semi"), "crowded-cells")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the vectors of each cell in a task, a bounded number of cells at a time."""
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x[0].tobytes() for x in held.values()], pa.binary()), pa.array([x[1] for x in held.values()], pa.int64())], names=["cell", "total", "n"])
            held.clear()
            return done

        for batch in batches:
            for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(raw, float)
                if cell in held:
                    held[cell] = [held[cell][0] + v, held[cell][1] + 1]
                else:
                    held[cell] = [v, 1]
            if len(held) > 10_000:
                yield out()
        yield out()

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            total, n = sum(np.frombuffer(x, float) for x in group.column(1).to_pylist()), sum(group.column(2).to_pylist())
            length = sqrt(float(total @ total))
            if length >= LONG_MEAN * n:
                yield pa.RecordBatch.from_arrays([group.column(0)[:1].combine_chunks(), pa.array([n], pa.int64()), pa.array([(total / length).tobytes()], pa.binary())], names=["node", "n", "unit"])

    totals = members.join(nodes.select("node", "unit"), "node").select("cell", "unit").mapInArrow(tidied(sums), "cell bigint, total binary, n bigint")
    centres = written(in_cells(totals, means, "node bigint, n bigint, unit binary"), "centres")
    half = cos(acos(threshold) / 2 - MARGIN)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [len(x) == len(y) and float(np.frombuffer(x, float) @ np.frombuffer(y, float)) >= half for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)], names=["node", "centre", "n"]).filter(pa.array(near, pa.bool_()))

    seen = range(CENTRE_RUNS)
    met = projected(nodes, cuts, seen).select("cell", "node").join(projected(centres, cuts, seen).select("cell", F.col("node").alias("centre")), "cell").select("node", "centre").distinct()
    near = met.join(nodes.select("node", "unit"), "node").join(centres.select(F.col("node").alias("centre"), "n", F.col("unit").alias("middle")), "centre")
    near = near.select("node", "centre", "n", "unit", "middle").mapInArrow(tidied(inside), "node bigint, centre bigint, n bigint")
    out = written(near.groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("ball")), "balls")
    discard(cells, members, centres)
    return out


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows (cell, value, node, ball) with `side` and `apart`: where apart, only nodes of different sides meet."""
    sizes = written(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large-cells")
    if sizes.isEmpty():
        return rows.select("cell", "value", "node", "ball", F.lit(0).alias("side"), F.lit(False).alias("apart"))
    of_ball = rows.join(sizes.select("cell"), "cell", "left_semi").filter("ball is not null").groupBy("cell", "ball").agg(F.count("*").alias("in_ball"))
    top = of_ball.groupBy("cell").agg(F.max(F.struct("in_ball", "ball")).alias("top"))
    sizes = sizes.join(top, "cell", "left").select("cell", F.col("top.ball").alias("top"), F.coalesce("top.in_ball", F.lit(0)).alias("n_top"), "n")
    sizes = sizes.select("cell", "top", F.ceil(F.col("n_top") / block).cast("int").alias("pieces"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n_top")) / block)).cast("int").alias("blocks"))
    d = rows.join(sizes, "cell", "left")
    in_top = F.coalesce(F.col("ball") == F.col("top"), F.lit(False))
    d = d.withColumn("in_top", in_top)
    hashed = F.xxhash64(F.lit(29), F.col("node"))
    d = d.withColumn("at", F.when(F.col("in_top"), F.pmod(hashed, F.col("pieces"))).otherwise(F.pmod(hashed, F.col("blocks"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda kind, a, b: F.xxhash64("cell", F.lit(kind), a.cast("int"), b.cast("int"))
    place = lambda c, side, apart: F.struct(c.alias("cell"), side.cast("int").alias("side"), apart.alias("apart"))
    with_rest = F.transform(numbers(F.col("blocks")), lambda b: place(key(1, F.col("at"), b), F.lit(0), F.lit(True)))
    of_rest = F.transform(numbers(F.col("blocks")), lambda b: place(key(0, F.least(F.col("at"), b), F.greatest(F.col("at"), b)), F.col("at"), F.col("at") != b))
    with_top = F.when(F.col("pieces") > 0, F.transform(numbers(F.greatest("pieces", F.lit(1))), lambda p: place(key(1, p, F.col("at")), F.lit(1), F.lit(True)))).otherwise(F.array().cast("array<struct<cell:bigint,side:int,apart:boolean>>"))
    alone = F.array(place(F.col("cell"), F.lit(0), F.lit(False)))
    # Of a block's own cell all nodes are on one side and all meet; of two blocks' cell they are on two sides.
    where = F.when(F.col("blocks").isNull(), alone).when(F.col("in_top"), with_rest).otherwise(F.concat(of_rest, with_top))
    return d.select(F.explode(where).alias("to"), "value", "node", "ball").select("to.cell", "value", "node", "ball", "to.side", "to.apart")


def collisions(rows: DataFrame, window: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of each collision of nodes that are not of one ball; a < b."""

    def pairs(v: np.ndarray, node: np.ndarray, ball: np.ndarray, side: np.ndarray, apart: bool) -> Iterator[pa.RecordBatch]:
        last = np.searchsorted(v, v + np.float32(window), "right")
        width = last - np.arange(len(v)) - 1
        a = 0
        while a < len(v):
            b = max(a + 1, int(np.searchsorted(np.cumsum(width[a:]), PAIRS_AT_ONCE, "right")) + a)
            i = np.repeat(np.arange(a, b), width[a:b])
            j = np.arange(len(i)) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b]) + i + 1
            keep = (ball[i] != ball[j]) | (ball[i] == 0)
            if apart:
                keep &= side[i] != side[j]
            x, y = node[i[keep]], node[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            a = b

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            if group.num_rows > 1:
                v, node, ball, side = (group.column(k).to_numpy() for k in (1, 2, 3, 4))
                yield from pairs(v, node, ball, side, any(group.column(5).to_pylist()))

    dealt = _dealt(rows, block).withColumn("ball", F.coalesce("ball", F.lit(0).cast("bigint")))
    return in_cells(dealt.select("cell", "value", "node", "ball", "side", "apart"), collide, "a bigint, b bigint", "cell", "value")


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [len(x) == len(y) and float(np.frombuffer(x, float) @ np.frombuffer(y, float)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(k), F.col("unit").alias(f"unit_{k}")) for k in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "unit_a", "unit_b").mapInArrow(tidied(check), "a bigint, b bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    rows = written(nodes_of(vectors, id_column, vector_column), "unit-vectors")
    nodes = written(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("unit").alias("unit")), "vector-nodes")
    cuts, runs, window = plan(nodes.count(), threshold, recall)
    of_ball = balls(nodes, cuts, threshold, dense)
    placed = written(nodes.join(of_ball, "node", "left").select("node", "unit", "ball", "copies", "first"), "placed-nodes")

    met: list[DataFrame] = []
    for a in range(0, runs, RUNS_AT_ONCE):
        found = collisions(projected(placed, cuts, range(a, min(runs, a + RUNS_AT_ONCE)), ("ball",)), window, block)
        met.append(written(found.groupBy("a", "b").agg(F.count("*").alias("n")), "collisions"))
    counts = met[0]
    for more in met[1:]:
        counts = counts.unionByName(more)
    candidates = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT).select("a", "b")
    links = written(verified(candidates, nodes, threshold), "vector-links")
    discard(*met)

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("beyond"))
    ball = placed.filter("ball is not null").groupBy("ball").agg(F.sum("copies").alias("in_ball"), F.min("node").alias("centre"))
    inner = placed.filter("ball is not null").select("node", "ball").join(ball, "ball")
    edges = links.unionByName(inner.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    parts = written(components(edges), "vector-components")
    zero = F.lit(0).cast("bigint")
    of_node = placed.select("node", "ball", "copies", "first").join(ball.select("ball", "in_ball"), "ball", "left").join(beyond, "node", "left").join(parts.withColumnRenamed("vertex", "node"), "node", "left")
    of_node = of_node.select("node", "first", F.coalesce("component", "node").alias("part"), (F.coalesce("in_ball", "copies") - 1 + F.coalesce("beyond", zero)).alias("n_links"))
    of_node = written(of_node, "node-links")
    ids = of_node.groupBy("part").agg(F.min("first").alias("component_id"))
    found = of_node.join(ids, "part").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(found, "node", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    out = written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-vectors")
    discard(rows, nodes, of_ball, placed, links, parts, of_node)
    return out
