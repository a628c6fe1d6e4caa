"""Conversation prefix trie: what conversations have in common from their first turns on.

A node is a distinct sequence of turns (role, text) that a conversation begins with; the root has none. Conversations are
dealt out in ranges of their ids. A task reads its conversations turn by turn, names each prefix by a hash of the prefix
before it and the turn (128 bits), and combines them in a table of nodes: members, least conversation, and the list of the
conversations that end there, in order. When that table is full, it is given out and begun again. The partial tries are
merged by the nodes' hashes, some of them at a time, until one is left; a node's lists follow each other, as ranges do.

Rollup: the nodes of which a conversation is the smallest member are a chain down to its end. Chains are summed from
the bottom up, and a chain's sum goes to all nodes above it, which lie on the path of the same conversation. So sums over
subtrees take one pass, whatever the depth, and no node's members or subtree are gathered anywhere.

Texts leave the first exchange as hashes (MD5 of role and text) and lengths.

Defined cases: null role and text are empty; turns are read by turn (null first), then role, then text, so repeated rows
are turns of their own; rows without conv_id belong to no conversation and are left out; a conversation may be left
without turns and then ends at the root; an empty table gives no rows; texts of any length are read whole; extra
columns are not read. A conversation is read by one task, a turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.groups import tidied

LOCAL_NODES = 200_000  # nodes of a partial trie, and ends that wait in it
LIST = 1024  # conversations in one piece of a list of ends
FAN = 16  # partial tries merged at a time
ROOT = bytes(16)
HEAD, SHARE = 6, 100  # a conversation takes fewer turns than HEAD from the first conversation of its SHARE

PATH, PIECE, ENDS = 0, 1, 2
PIECES = "kind int, part bigint, node binary, parent binary, depth bigint, conv_id bigint, chars bigint, members bigint, ends array<bigint>"


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_key, chars) of each turn, places from 1."""
    empty = F.lit("")
    d = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return d.filter("conv_id is not null").select("conv_id", F.row_number().over(order).alias("place"), key.alias("turn_key"), F.length("text").cast("bigint").alias("chars"))


def rebuilt(conversations: DataFrame, head: int = HEAD, share: int = SHARE) -> DataFrame:
    """(conv_id, part, place, turn_key, chars): the first h turns of conversation c - c % share, then c's own after its first h,
    h = crc32(c in decimal) % head; a row of part 0 begins each conversation."""
    placed = in_order(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    own = placed.filter(F.col("place") > h).select("conv_id", F.lit(2).alias("part"), "place", "turn_key", "chars")
    all_ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).filter("conv_id is not null").distinct()
    first = in_order(conversations.filter(F.col("conv_id") % share == 0)).filter(F.col("place") < head).withColumnRenamed("conv_id", "base")
    heads = all_ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % share).alias("base"), h.alias("h")).join(first, "base").filter("place <= h")
    begin = all_ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("chars"))
    return begin.unionByName(heads.select("conv_id", F.lit(1).alias("part"), "place", "turn_key", "chars")).unionByName(own)


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn_key, chars) of conversations as they are."""
    placed = in_order(conversations)
    begin = placed.select("conv_id").distinct().select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("chars"))
    return begin.unionByName(placed.select("conv_id", F.lit(2).alias("part"), "place", "turn_key", "chars"))


def partial_tries(turns: DataFrame, tasks: int) -> DataFrame:
    """Pieces of partial tries of ranges of conversations, and the paths of the conversations that may be a node's smallest
    member: those that brought a node to their task's trie."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("chars", pa.int64()), ("members", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}
        ends: dict[bytes, list[int]] = {}
        rows: list[tuple] = []
        held: list[tuple] = []  # the path of a conversation that is in the trie so far
        conv, node, depth, waiting = None, ROOT, 0, 0

        def end() -> None:
            nonlocal waiting
            if conv is not None:
                waiting += 1
                ids = ends.setdefault(node, [])
                ids.append(conv)
                if len(ids) >= LIST:
                    rows.append((ENDS, part, node, None, None, ids[0], None, None, ends.pop(node)))

        def flush() -> None:
            nonlocal waiting
            rows.extend((PIECE, part, key, parent, at, least, chars, members, None) for key, (parent, at, least, chars, members) in nodes.items())
            rows.extend((ENDS, part, key, None, None, ids[0], None, None, ids) for key, ids in ends.items())
            nodes.clear()
            ends.clear()
            waiting = 0

        for batch in batches:
            for c, begins, key, chars in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if begins == 0:
                    end()
                    if waiting >= LOCAL_NODES or len(nodes) >= LOCAL_NODES:
                        flush()
                    conv, node, parent, depth = c, ROOT, None, 0
                    held.clear()
                else:
                    parent, node, depth = node, hashlib.blake2b(node + key, digest_size=16).digest(), depth + 1
                found = nodes.get(node)
                held.append((PATH, part, node, None, depth, c, None, None, None))
                if found is None:
                    nodes[node] = [parent, depth, c, chars, 1]
                    rows += held
                    held.clear()
                    if len(nodes) >= 2 * LOCAL_NODES:  # one long conversation
                        flush()
                else:
                    found[4] += 1
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows.clear()
        end()
        flush()
        for k in range(0, len(rows), 20_000):
            yield out(rows[k : k + 20_000])

    dealt = turns.repartitionByRange(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", "turn_key", "chars")
    return dealt.mapInArrow(tidied(build), PIECES)


def merged(pieces: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """(node, parent, depth, conv_id, chars, n_convs): partial tries merged by the nodes' hashes, fan of them at a time."""
    now = pieces.select("node", "part", "parent", "depth", "conv_id", "chars", F.col("members").alias("n_convs"))
    while True:
        parts = -(-parts // fan)
        now = now.groupBy("node", F.floor(F.col("part") / fan).alias("part")).agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.sum("n_convs").alias("n_convs"))
        if parts <= 1:
            return now.drop("part")


def end_digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256): the pieces of a node's list one after the other, hashed as they come."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def rows(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids)).encode())
            yield rows(done)
        if node is not None:
            yield rows([(node, state.hexdigest())])

    return pieces.select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends").mapInArrow(tidied(digest), "node binary, ends_sha256 string")


def trie(turns: DataFrame, tasks: int | None = None, fan: int = FAN) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    turns: as of rebuilt() or plain()."""
    spark = turns.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(partial_tries(turns, tasks), "partial-tries")
    nodes = written(merged(pieces.filter(F.col("kind") == PIECE), _parts(pieces), fan), "trie-nodes")

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("bigint")
    full = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    full = full.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("own_saved", F.sum("saved").over(below)).withColumn("own_leaves", F.sum("leaf").over(below))
    full = written(full.drop("saved", "leaf"), "chains")

    # The upper end of a chain holds its sums.
    chains = full.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("own_saved").alias("saved"), F.max("own_leaves").alias("leaves"))
    above = pieces.filter(F.col("kind") == PATH).select("conv_id", "depth", "node").join(chains, "conv_id").filter("depth < top")
    above = above.groupBy("node").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    ends = end_digests(pieces.filter(F.col("kind") == ENDS))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = full.join(above, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    out = rows.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("own_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = written(out, "trie")
    discard(pieces, nodes, full)
    return out


def _parts(pieces: DataFrame) -> int:
    return (pieces.agg(F.max("part")).first()[0] or 0) + 1
