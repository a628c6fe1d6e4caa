"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles; rows of equal sets are one node. A node carries 128
MinHash coordinates, which stand for its set: a token is a coordinate with its value, and two sets
share a token with the probability of their Jaccard similarity.

Each run is a tree. At a tree node one coordinate is sampled, two in a quarter of cases (1 / 0.8 on
average), and every set goes on to the children of its values there, so similar sets keep meeting
while others part. Children of one set are dropped; a small child is a leaf; a large child goes on
down, unless it did not shrink, in which case its members are alike and it is a leaf too. Leaves are compared by
brute force on eight bits of each coordinate; large leaves are dealt out in cells of two blocks.
Runs are repeated until the chance to have missed a pair at the threshold is below 1 - recall at the depth that the
deepest tree reaches.

The pairs that meet give candidate classes (components of a spanning forest of each leaf, so that
a group of copies never becomes all its pairs). Within a class the exact sets are compared, each pair
in exactly one cell: links are counted and classes are parted where no exact link holds them.

Result: one row for each document: doc_id, class_id (the least doc_id of its class, its own if
alone), n_links (other rows with a similarity of at least the threshold, equal sets included).

Node keys are 64-bit hashes of the sets, so of n different sets about n**2 / 2**65 pairs would be
taken for equal.

thinned() gives one row of each class instead, of the least doc_id, then of the least hash of its text.

Defined cases: null and blank texts have no shingles, are alone and have no links; texts under
five words have one shingle; rows without doc_id are counted as links and get null as their own
id (class_id is the least id of the class, null if there is none), and texts are fetched by id and
hash, so rows without id do not meet in one key; rows with equal ids are rows of their own, their
classes are apart unless their texts are similar; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.components import components
from brindle.llm.groups import dealt, forest, grouped, in_cells, similar, tidied
from brindle.llm.shingles import SHINGLE, coefficients, minhashes, mixed, shingle_set

COORDINATES = 128
THRESHOLD, RECALL = 0.8, 0.9999
LEAF, BLOCK, BLOCK_TOKENS = 1024, 512, 500_000
MOST_LEVELS = 12
NO_ID = (1 << 63) - 1
TWO_IN = 4  # at one tree node in four, two coordinates are sampled


def set_key(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def meeting_chance(threshold: float, depth: int) -> float:
    """Least chance that two sets of that similarity share a path of this depth in one run."""
    p = 1.0
    for _ in range(depth):
        one, two = threshold * p, 1 - (1 - threshold * p) ** 2
        p = one * (1 - 1 / TWO_IN) + two / TWO_IN
    return p


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return max(1, ceil(log(1 - recall) / log(1 - meeting_chance(threshold, depth))))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, text): ids that are null last, a hash of each text, and its bytes."""
    text = F.col(text_column).cast("binary")
    return docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, text_key, node, coordinates) of each row; node and coordinates are null where there are no words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(COORDINATES, 1)
        for batch in batches:
            nodes, values = [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py() or b"", shingle)
                nodes.append(set_key(found) if len(found) else None)
                values.append(minhashes(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["id", "text_key", "node", "coordinates"])

    return _keyed(docs, id_column, text_column).mapInArrow(tidied(sketch), "id bigint, text_key bigint, node bigint, coordinates binary")


def _coordinates_at(path: np.ndarray, k: int) -> np.ndarray:
    """The k-th coordinate sampled at each tree node."""
    with np.errstate(over="ignore"):
        return (mixed(path * np.uint64(2) + np.uint64(k)) % np.uint64(COORDINATES)).astype(np.int64)


def _children(path: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the children that each row goes on to. path: of each row, values: its coordinates."""
    rows, out = [], []
    for k in (0, 1):
        here = np.arange(len(path)) if k == 0 else np.flatnonzero(mixed(path ^ np.uint64(0x5DEECE66D)) % np.uint64(TWO_IN) == 0)
        at = _coordinates_at(path[here], k)
        with np.errstate(over="ignore"):
            child = mixed(mixed(path[here] + np.uint64(0x632BE59BD9B4E019)) ^ (values[here, at].astype(np.uint64) << np.uint64(8) | at.astype(np.uint64)))
        rows.append(here)
        out.append(child)
    return np.concatenate(rows), np.concatenate(out)


def _descend(frame: DataFrame, runs: int | None, done: int = 0) -> DataFrame:
    """(path, node, above) one level down. frame: node, coordinates[, path, members]; with runs, from the roots."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
            if runs:
                todo = [(np.full(len(nodes), r + 1, np.uint64), np.full(len(nodes), NO_ID)) for r in range(done, done + runs)]
            else:
                todo = [(batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy())]
            for path, above in todo:
                rows, child = _children(mixed(path), values)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(nodes[rows]), pa.array(above[rows])], names=["path", "node", "above"])

    return frame.mapInArrow(tidied(step), "path bigint, node bigint, above bigint")


def repeated_leaves(nodes: DataFrame, threshold: float, recall: float, leaf: int = LEAF) -> list[DataFrame]:
    """leaves() of as many runs as the recall takes at the depth that the trees reach."""
    done, depth, out = 0, 2, []
    while done < runs_for(threshold, recall, depth):
        wanted = runs_for(threshold, recall, depth)
        found = leaves(nodes, wanted - done, leaf, done)
        out += found
        done, depth = wanted, max(depth, len(found))
    return out


def leaves(nodes: DataFrame, runs: int, leaf: int = LEAF, done: int = 0) -> list[DataFrame]:
    """Written tables (path, node, members) of the leaves of all runs, a table for each level; runs that are done are
    not made again."""
    out: list[DataFrame] = []
    here = _descend(nodes.select("node", "coordinates"), runs, done)
    for level in range(1, MOST_LEVELS + 1):
        here = here.distinct() if level > 1 else here
        sizes = here.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
        table = written(here.join(sizes, "path").select("path", "node", "members", "above"), f"paths-{level}")
        out.append(table)
        large = (F.col("members") > leaf) & (F.col("members") * 2 <= F.col("above")) & F.lit(level < MOST_LEVELS)
        on = table.filter(large)
        if on.isEmpty():
            break
        out[-1] = _kept(table, ~large)
        here = _descend(on.join(nodes.select("node", "coordinates"), "node").select("node", "coordinates", "path", "members"), None)
    return out


def _kept(table: DataFrame, condition) -> DataFrame:
    kept = table.filter(condition)
    kept._brindle_path = table._brindle_path
    return kept


def candidate_edges(nodes: DataFrame, found: list[DataFrame], threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of a spanning forest of each cell of the leaves, by agreement of eight bits of the coordinates."""
    agree = int(COORDINATES * threshold - 4 * sqrt(COORDINATES * threshold * (1 - threshold)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in grouped(batches):
            n = group.num_rows
            if n < 2:
                continue
            ids = group.column(1).to_numpy()
            bits = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint8).reshape(n, COORDINATES)
            for i, j in forest(n, lambda i, others: np.count_nonzero(bits[others] == bits[i], axis=1) >= agree):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in data], pa.binary())], names=["node", "bits"])

    rows = found[0].select("path", "node", "members")
    for table in found[1:]:
        rows = rows.unionByName(table.select("path", "node", "members"))
    bits = nodes.select("node", "coordinates").mapInArrow(tidied(low_bytes), "node bigint, bits binary")
    cells = dealt(rows.join(bits, "node"), "path", "members", "node", block)
    return in_cells(cells.select("cell", "node", "bits"), compare, "a bigint, b bigint")


def exact_links(members: DataFrame, threshold: float, block_tokens: int = BLOCK_TOKENS, block: int = BLOCK) -> DataFrame:
    """Compare exact sets within candidate classes. members: class, node, shingles, copies, id (least doc_id).

    Returns rows (node, label, links, other): a node's links with their copies in one cell; label is the node of the
    least id of its class where the class is one cell, else null, and then rows with `other` are exact edges."""
    of_class = members.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles") / 8).alias("t"))
    of_class = of_class.withColumn("weight", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("t") / block_tokens)))
    cells = dealt(members.join(of_class, "class"), "class", "weight", "node", 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "label", "links", "other"]
        kinds = [pa.int64()] * len(names)
        out: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for c in out:
                c.clear()
            return done

        for group in grouped(batches):
            nodes, copies, ids, block_of, blocks = (group.column(k).to_numpy() for k in (1, 3, 4, 5, 6))
            sets = [np.frombuffer(x, "<u8") for x in group.column(2).to_pylist()]
            n = len(sets)
            alone = blocks[0] == 1
            near = similar(sets, threshold) if n > 1 else np.zeros((n, n), bool)
            if not alone and group.column(7)[0].as_py() != group.column(8)[0].as_py():
                near &= block_of[:, None] != block_of[None, :]  # pairs within a block meet in its own cell, even if the other is empty
            links = near @ copies if n > 1 else np.zeros(n, np.int64)
            edges = forest(n, lambda i, others: near[i, others])
            label = [None] * n
            if alone:
                up = list(range(n))

                def root(v: int) -> int:
                    while up[v] != v:
                        v = up[v]
                    return v

                for i, j in edges:
                    i, j = root(i), root(j)
                    if (ids[i], nodes[i]) > (ids[j], nodes[j]):
                        i, j = j, i
                    up[j] = i
                label = [int(nodes[root(v)]) for v in range(n)]
                edges = []
            for row in zip(nodes.tolist(), label, np.asarray(links).tolist(), [None] * n):
                for c, v in zip(out, row):
                    c.append(v)
            for i, j in edges:
                for c, v in zip(out, (int(nodes[i]), None, 0, int(nodes[j]))):
                    c.append(v)
            if len(out[0]) > 50_000:
                yield flush()
        yield flush()

    rows = cells.select("cell", "node", "shingles", "copies", "id", "block", "blocks", "low", "high")
    return in_cells(rows, compare, "node bigint, label bigint, links bigint, other bigint")


def classes_of(docs: DataFrame, threshold: float, recall: float, shingle: int, id_column: str, text_column: str, leaf: int, block: int, block_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables of the rows (id, text_key, node) and of the nodes: node, first (least id and text_key of its rows),
    class (a node that stands for the class), n_links of each row; and the table that the rows are read from."""
    rows = written(sketches(docs, id_column, text_column, shingle), "sketches")
    # Equal sets have equal coordinates, so any of a node's rows gives them.
    first = F.min(F.struct("id", "text_key")).alias("first")
    nodes = written(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), first, F.first("coordinates").alias("coordinates")), "nodes")

    found = repeated_leaves(nodes, threshold, recall, leaf)
    candidates = components(candidate_edges(nodes, found, threshold, block)).withColumnRenamed("component", "class")
    candidates = written(candidates.withColumnRenamed("vertex", "node"), "candidate-classes")
    discard(*found)

    def exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(4)]
            same = pa.array([len(s) > 0 and set_key(s) == n for s, n in zip(sets, batch.column(1).to_pylist())], pa.bool_())
            done = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "node", "copies", "id", "shingles"])
            yield done.filter(same)  # another text with the hash of this one

    chosen = candidates.join(nodes.select("node", "copies", "first.id", "first.text_key"), "node")
    members = chosen.join(_keyed(docs, id_column, text_column), ["id", "text_key"]).select("class", "node", "copies", "id", "text")
    members = members.mapInArrow(tidied(exact_sets), "class bigint, node bigint, copies bigint, id bigint, shingles binary")
    members = written(members.dropDuplicates(["node"]), "members")

    compared = written(exact_links(members, threshold, block_tokens, block), "links")
    linked = compared.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    edges = compared.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not edges.isEmpty():
        parts = components(edges).select(F.col("vertex").alias("node"), "component")
        linked = linked.join(parts, "node", "left").select("node", "links", F.coalesce("label", "component").alias("label"))
    of_node = nodes.select("node", "copies", "first").join(linked, "node", "left")
    of_node = of_node.select("node", "first", F.coalesce("label", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_node = written(of_node, "node-classes")
    discard(nodes, candidates, members, compared)
    return rows.select("id", "text_key", "node"), of_node, rows


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", leaf: int = LEAF, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs."""
    rows, of_node, sketched = classes_of(docs, threshold, recall, shingle, id_column, text_column, leaf, block, block_tokens)
    ids = of_node.groupBy("class").agg(F.min("first.id").alias("class_id"))
    out = rows.select("id", "node").join(of_node.select("node", "class", "n_links").join(ids, "class"), "node", "left")

    def real(c):
        return F.when(c != NO_ID, c)

    out = out.select(real(F.col("id")).alias("doc_id"), real(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = written(out, "near-duplicates")
    discard(sketched, of_node)
    return out


def thinned(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", leaf: int = LEAF, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row of each class, with the columns of docs; rows without words are alone and all stay. Of rows of one id and one text
    that differ in other columns the least by all columns stays."""
    _, of_node, sketched = classes_of(docs, threshold, recall, shingle, id_column, text_column, leaf, block, block_tokens)
    kept = of_node.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__kept_id"), F.col("first.text_key").alias("__kept_key"))
    kept = written(kept, "kept-rows")
    discard(sketched, of_node)
    keyed = docs.withColumn("__kept_id", F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID))).withColumn("__kept_key", F.xxhash64(F.col(text_column).cast("binary")))
    # Rows of equal id and text become one in their own tasks first; the join then needs no other exchange of the texts.
    one = keyed.groupBy("__kept_id", "__kept_key").agg(F.min(F.struct(*docs.columns)).alias("__one"))
    one = one.join(kept, ["__kept_id", "__kept_key"], "left_semi").select("__one.*")
    blank = ~F.coalesce(F.col(text_column), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return one.unionByName(docs.filter(blank))
