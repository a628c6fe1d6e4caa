"""Threshold joins of vectors by pivots: cells around pivots, pruned by the triangle inequality of angles.

Vectors of a scope go to the nearest of the scope's pivots, which makes cells; the more vectors a scope has the more pivots it uses, and
a small one is a single cell. Two cells are compared only if their radii and the angle of the least similarity bridge the angle
between their pivots, and of a cell only the vectors that may reach the other one. What is left is compared block by block as
products of matrices, so pairs never become rows. The pruning only leaves out pairs that are certainly below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.operators.search import small, top_k
from brindle.operators.vector_index import usable
from brindle.session import stored

PIVOTS, CELL_ROWS, BLOCK = 256, 256, 1024
PANEL = 4096  # vectors that are handed on together; BLOCK of them are multiplied at once
SLACK = 1e-6  # radians, for the rounding of angles


def pivots_of(vectors: DataFrame, n: int, most: int = PIVOTS) -> np.ndarray:
    """At most so many unit vectors (column v) of one size out of n, of the lowest hashes. Any pivots give right answers, so a sample
    does; only the part of the hashes that is expected to hold eight times as many is made distinct."""
    part = F.lit(int((1 << 62) * min(1.0, 8.0 * most / max(1, n))))
    v = vectors.select(F.xxhash64("v").alias("h"), "v").filter((F.shiftrightunsigned("h", 2) <= part) & F.exists("v", lambda x: x != 0.0))
    rows = v.distinct().orderBy("h", "v").limit(most).collect()  # bounded by most
    if not rows:
        return np.zeros((1, 1))
    x = np.array([r["v"] for r in rows if len(r["v"]) == len(rows[0]["v"])], float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def celled(questions: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(scope, t, item, v, cell, angle, norm) of (scope, t, item, v, uses): the nearest of the first `uses` pivots and the angle to it.
    A vector of another size than the pivots' is in cell 0 at an angle that nothing is pruned by."""
    sent = questions.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        centres = sent.value
        for batch in batches:
            x = batch.column("v")
            lengths = np.diff(x.offsets.to_numpy())
            cell, angle, norm = np.zeros(len(x), np.int32), np.full(len(x), np.pi), np.zeros(len(x))
            flat, starts = x.values.to_numpy(), x.offsets.to_numpy()
            norm[lengths > 0] = np.sqrt(np.add.reduceat(np.append(flat**2, 0.0), starts[:-1][lengths > 0])) if (lengths > 0).any() else 0.0
            same = np.flatnonzero((lengths == centres.shape[1]) & (norm > 0))
            if len(same):
                vectors = flat[starts[same][:, None] + np.arange(centres.shape[1])] / norm[same][:, None]
                cos = vectors @ centres.T
                cos[np.arange(len(centres))[None, :] >= batch.column("uses").to_numpy()[same][:, None]] = -2.0
                cell[same] = cos.argmax(axis=1)
                angle[same] = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
            kept = [batch.column(c) for c in ("__scope", "__t", "__item", "v")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cell), pa.array(angle), pa.array(norm)], names=["__scope", "__t", "__item", "v", "__cell", "angle", "norm"])

    q = questions.select("__scope", "__t", "__item", "v", "uses")
    kinds = {c: q.schema[c].dataType.simpleString() for c in ("__scope", "__t", "__item")}
    return q.mapInArrow(assign, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", v array<double>, __cell int, angle double, norm double")


def cells_to_compare(cells: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """(scope, cell, other, between, reach, radius, other_radius, first, last, blocks, other_blocks, pairs): pairs of cells of which the first
    may hold a question that one of the second, earlier, answers. between is the angle of their pivots, reach how far apart a
    pair may be."""
    angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0)) if len(pivots) > 1 else np.zeros((1, 1))
    i, j = np.indices(angles.shape)
    between = cells.sparkSession.createDataFrame(list(zip(i.ravel().tolist(), j.ravel().tolist(), angles.ravel().tolist())), "__cell int, __other int, between double")
    names = {"__cell": "__other", "radius": "other_radius", "norm": "other_norm", "first": "earliest", "last": "other_last", "blocks": "other_blocks", "n": "other_n"}
    other = cells.select("__scope", *[F.col(a).alias(b) for a, b in names.items()])
    pairs = cells.join(other, "__scope").filter(F.col("earliest") < F.col("last")).join(F.broadcast(between), ["__cell", "__other"])  # PIVOTS squared rows
    least_cos = F.try_divide(F.lit(float(least)), F.col("norm") * F.col("other_norm"))  # null for zero vectors
    reach = F.lit(float(np.pi)) if least <= 0 else F.acos(F.least(least_cos, F.lit(1.0))) + SLACK
    pairs = pairs.withColumn("reach", reach).filter(F.col("between") - F.col("radius") - F.col("other_radius") <= F.col("reach"))
    if least > 0:
        pairs = pairs.filter(least_cos <= 1.0 + SLACK)
    return pairs.select("__scope", "__cell", "__other", "between", "reach", "radius", "other_radius", "earliest", "last", "blocks", "other_blocks", (F.col("n") * F.col("other_n")).alias("pairs"))


def _prepared(questions: DataFrame, least: float, scope: str, at: str, item: str, vector: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vectors in cells, pairs of cells to compare, pivots)."""
    v = F.col(vector).cast("array<double>")
    q = questions.select(F.col(scope).alias("__scope"), F.col(at).alias("__t"), F.col(item).alias("__item"), v.alias("v"))
    q = q.filter(usable(F.col("v")) & F.col("__scope").isNotNull() & F.col("__t").isNotNull())
    size = q.groupBy("__scope").agg(F.count("*").alias("n"))
    uses = F.least(F.lit(PIVOTS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / CELL_ROWS))))).cast("int").alias("uses")
    pivots = pivots_of(q, size.agg(F.sum("n")).first()[0] or 0)
    vectors = stored(celled(q.join(small(size.select("__scope", uses)), "__scope"), pivots))
    cells = vectors.groupBy("__scope", "__cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("radius"), F.max("norm").alias("norm"), F.min("__t").alias("first"), F.max("__t").alias("last"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    return vectors, stored(cells_to_compare(cells, pivots, least)), pivots


def comparisons(questions: DataFrame, least: float = 0.96, scope: str = "scope", at: str = "ts", item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(scope, n, pairs): questions of each scope, and pairs (either way round) in the cells that cached_answers compares."""
    vectors, pairs, _ = _prepared(questions, least, scope, at, item, vector)
    n = vectors.groupBy("__scope").agg(F.count("*").alias("n"))
    met = pairs.groupBy("__scope").agg(F.sum("pairs").alias("pairs"))
    return n.join(met, "__scope", "left").select(F.col("__scope").alias(scope), "n", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def _panels(vectors: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """(scope, panel, panels of the scope, partners, rows) of all vectors, some PANEL of neighbouring cells in a row each, and the most panels that a scope
    has. partners are the panels that it is to be compared with; of two panels one has the other."""
    cells = vectors.groupBy("__scope", "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__scope").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.ceil(F.sum("n").over(Window.partitionBy("__scope")) / PANEL).cast("int").alias("panels")
    cells = stored(cells.select("__scope", "__cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), whole))
    of = lambda place: F.floor(place / PANEL).cast("int")
    span = F.sequence(of(F.col("start")), of(F.col("start") + F.col("n") - 1))
    a, b = (cells.select("__scope", F.col("__cell").alias(c), span.alias(s)) for c, s in (("__cell", "a"), ("__other", "b")))
    met = pairs.select("__scope", "__cell", "__other").join(small(a, part_of=cells), ["__scope", "__cell"]).join(small(b, part_of=cells), ["__scope", "__other"])
    met = met.select("__scope", F.explode("a").alias("a"), "b").select("__scope", "a", F.explode("b").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    even = (low + high) % 2 == 0  # so each panel has about half of the others
    met = met.select("__scope", F.when(even, low).otherwise(high).alias("panel"), F.when(even, high).otherwise(low).alias("partner"))
    partners = met.groupBy("__scope", "panel").agg(F.collect_set("partner").alias("partners"))
    v = vectors.join(small(cells), ["__scope", "__cell"])
    v = v.withColumn("panel", of(F.col("start") + F.pmod(F.xxhash64("__item", "__t", "v"), F.col("n"))))
    rows = v.groupBy("__scope", "panel").agg(F.first("panels").alias("panels"), F.collect_list(F.struct("__cell", "__item", "__t", "angle", "norm", "v")).alias("rows"))
    panels = stored(rows.join(partners.hint("merge"), ["__scope", "panel"], "left"))
    return panels, cells.agg(F.max("panels")).first()[0] or 0


def _side(rows: pa.StructArray) -> dict:
    """Columns of a panel in order of ids."""
    t = pa.Table.from_arrays([rows.field(k) for k in range(rows.type.num_fields)], names=[f.name for f in rows.type]).sort_by("__item").combine_chunks()
    return {f: t.column(f).combine_chunks() for f in t.column_names} | {"size": np.array(pc.list_value_length(t.column("v")))}


def _answers(scores: np.ndarray, x: np.ndarray, y: np.ndarray, asked: np.ndarray, told: np.ndarray, least: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the best earlier column of each row. scores may be wrong by slack: what may be best by them is computed in
    doubles; of equal ones the first column."""
    rows = np.flatnonzero(scores.max(axis=1) >= least - slack)
    part = np.where(told[None, :] < asked[rows][:, None], scores[rows], -np.inf)
    bound = np.maximum(part.max(axis=1, initial=-np.inf) - 2 * slack, least - slack)
    i, j = np.nonzero(part >= bound[:, None])
    found = np.empty(len(i))
    for k in range(0, len(i), 1 << 16):
        found[k : k + (1 << 16)] = np.round(np.einsum("ij,ij->i", x[rows[i[k : k + (1 << 16)]]], y[j[k : k + (1 << 16)]]), 12)
    hit = found >= least
    i, j, found = i[hit], j[hit], found[hit]
    order = np.lexsort((j, -found, i))
    first = order[np.flatnonzero(np.append(True, np.diff(i[order]) != 0))] if len(order) else order
    return rows[i[first]], j[first], found[first]


def _compared(a: dict, b: dict | None, pivots: np.ndarray, least: float):
    """(items, answered by, similarities) of two panels, either way round, or of one within itself."""
    own, b = b is None, a if b is None else b
    times = [np.asarray(s["__t"]) for s in (a, b)]
    ranks = np.unique(np.concatenate(times), return_inverse=True)[1]
    ta, tb = ranks[: len(times[0])], ranks[len(times[0]) :]
    angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0)) if len(pivots) > 1 else np.zeros((1, 1))

    def cells(s: dict, n: int) -> list[tuple[int, np.ndarray, float, float]]:
        at, cell, angle, norm = np.flatnonzero(s["size"] == n), np.asarray(s["__cell"]), np.asarray(s["angle"]), np.asarray(s["norm"])
        return [(c, k := at[cell[at] == c], angle[k].max(), norm[k].max()) for c in np.unique(cell[at]).tolist()]

    def far(one: tuple, two: tuple) -> bool:
        """True if no two vectors of two cells can be alike enough."""
        if least <= 0:
            return False
        product = one[3] * two[3]
        cos = least / product if product else np.inf
        return cos > 1 + SLACK or angles[one[0], two[0]] - one[2] - two[2] > np.arccos(min(cos, 1.0)) + SLACK

    for n in np.intersect1d(a["size"], b["size"]).tolist():
        others = cells(b, n)
        for one in cells(a, n):
            near = [two for two in others if not far(one, two)]
            if not near:
                continue
            at = np.sort(np.concatenate([two[1] for two in near]))
            y = b["v"].take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
            most = one[3] * max(two[3] for two in near)
            kind = np.float32 if 1e-9 < most < 1e9 and max(one[3], *(two[3] for two in near)) < 1e9 else np.float64
            slack = (n + 8) * float(np.finfo(kind).eps) * most + 1e-12
            y_kind = y.astype(kind, copy=False)
            for k in range(0, len(one[1]), BLOCK):
                mine = one[1][k : k + BLOCK]
                x = a["v"].take(pa.array(mine)).flatten().to_numpy().reshape(-1, n)
                scores = x.astype(kind, copy=False) @ y_kind.T
                i, j, found = _answers(scores, x, y, ta[mine], tb[at], least, slack)
                yield a["__item"].take(pa.array(mine[i])), b["__item"].take(pa.array(at[j])), found
                if not own:
                    i, j, found = _answers(scores.T, y, x, tb[at], ta[mine], least, slack)
                    yield b["__item"].take(pa.array(at[i])), a["__item"].take(pa.array(mine[j])), found


def cached_answers(questions: DataFrame, least: float = 0.96, scope: str = "scope", at: str = "ts", item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item, answered_by, similarity): the earlier question of the same scope that is most alike by dot product (to 12 places), of the
    least similarity or more; of equal ones that of the least id.

    Vectors lie in panels of neighbouring cells. A scope of one panel is compared within its row; of larger ones each task takes some panels
    and reads the others past them from where they are stored (a cartesian product of files), so vectors are shuffled once and never written for each
    partner: work and reading grow with the square of a scope that the bound can't part, disk does not. Panels are multiplied in floats where that is
    certain enough to tell what may be best, which is then computed in doubles.

    Defined cases: questions without a scope, a time or a vector, or with a null or non-finite component, are left out; vectors of
    different sizes answer nothing; questions of one time don't answer each other; rows of one id are one question; an empty table gives no rows."""
    vectors, pairs, pivots = _prepared(questions, least, scope, at, item, vector)
    panels, most = _panels(vectors, pairs)
    kind, name = to_arrow_type(questions.schema[item].dataType), questions.schema[item].dataType.simpleString()
    sent = questions.sparkSession.sparkContext.broadcast(pivots)

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (_side(c.slice(k, 1).flatten()) if c.is_valid()[k].as_py() else None for c in (batch.column(0), batch.column(1)))
                for asked, told, found in _compared(a, b, sent.value, least):
                    yield pa.RecordBatch.from_arrays([asked.cast(kind), told.cast(kind), pa.array(found)], names=["__item", "answered_by", "similarity"])

    alone = panels.filter("panels = 1 and partners is not null").select("rows", F.lit(None).cast(panels.schema["rows"].dataType).alias("others"))
    if most > 1:
        one, other = (panels.filter("panels > 1").alias(x) for x in "ab")
        met = one.join(other.hint("shuffle_replicate_nl"), (F.col("a.__scope") == F.col("b.__scope")) & F.array_contains("a.partners", F.col("b.panel")))
        alone = alone.unionByName(met.select("a.rows", F.when(F.col("a.panel") != F.col("b.panel"), F.col("b.rows")).alias("others")))
    met = alone.mapInArrow(compare, f"__item {name}, answered_by {name}, similarity double")
    return top_k(met, "__item", 1, F.desc("similarity"), F.asc("answered_by")).select(F.col("__item").alias(item), "answered_by", "similarity")
