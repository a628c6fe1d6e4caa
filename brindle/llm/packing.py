"""Order-preserving packing of token streams by dynamic programming.

Documents follow each other in ascending order of their ids; a sequence is a window of that
stream, so packing means choosing the cuts. Places for a cut are document ends, all ends of
sentences, and, where two of those lie far apart, places between. The cost of a choice is

    sum over sequences of padding(length) + penalty(cut)

with padding 0 at a full window or at a power of two, and a penalty that is 0 at a document
end, small at a sentence end and large elsewhere. For position j the best predecessor i is either
one that lies within one window and minimises best[i] + i, where a monotone queue of predecessors
gives each transition in constant time on average, or one that lies a power of two before j,
if there is a place for a cut.

A range of documents (one task) is solved in blocks of tokens: a block's windows are fixed
but for its last, whose tokens open the next block, so memory is bounded by the block and a
block's end costs no padding. What is left at the end of a range is cut at powers of two
where that is cheaper than padding it. Ranges are bounded by rows and by bytes, as record_files.ranges_for says.

Defined cases: a null text is the empty text (its end id alone); documents longer than a
window are cut over several; repeated ids are packed each, in order of the beginnings and hashes of their texts; rows without an
id come first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import written
from brindle.llm.groups import tidied
from brindle.llm.record_files import by_id_ranges
from brindle.llm.token_ids import encoder

ROWS_PER_RANGE, BYTES_PER_RANGE = 16_384, 32 << 20
BLOCK_TOKENS = 1 << 20
SENTENCE_ENDS = (".", "!", "?")
SENTENCE_PENALTY, HARD_PENALTY = 8.0, 128.0


def padding(length: int, window: int) -> int:
    """Tokens of padding a sequence needs: none when full or at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def candidates(sentence_ends: np.ndarray, doc_ends: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, ascending, and their penalties: all ends of sentences and documents; gaps of over an
    eighth of a window get places between."""
    kind = np.zeros(total + 1, np.int8)  # 0: no place, 1: a place between, 2: a sentence end, 3: a document end
    kind[sentence_ends] = 2
    kind[doc_ends] = 3
    kind[0] = 0
    step = max(1, window // 8)
    bounds = np.concatenate(([0], np.flatnonzero(kind), [total]))
    for k in np.flatnonzero(np.diff(bounds) > step).tolist():
        kind[bounds[k] + step : bounds[k + 1] : step] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, HARD_PENALTY, SENTENCE_PENALTY, 0.0])[kind[at]]


def powers_before(places: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(j, i) of all pairs of places, as indices, that are a power of two below the window apart; ascending j."""
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(len(places))
    found_j, found_i = [], []
    power = 1
    while power < window:
        j = np.flatnonzero(places >= power)
        i = index[places[j] - power]
        found_j.append(j[i >= 0])
        found_i.append(i[i >= 0])
        power *= 2
    j, i = np.concatenate(found_j or [index[:0]]), np.concatenate(found_i or [index[:0]])
    order = np.argsort(j, kind="stable")
    return j[order].tolist(), i[order].tolist()


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The cheapest cuts of the stream that `at` ends: positions of `at`, the last one included.
    The last window is free of padding and penalty; the caller cuts it further or carries it on."""
    if not len(at):
        return []
    places, costs = [0, *at.tolist()], [0.0, *penalty.tolist()]
    exact_j, exact_i = powers_before(np.append(0, at), window)
    exact_j.append(len(places))
    k = 0
    best, before = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best + position, index), values ascending
    last = len(places) - 1
    for j in range(1, last + 1):
        here = places[j]
        while places[queue[0][1]] < here - window:
            queue.popleft()
        if j == last:
            # No padding for the last window: the predecessor with the least cost in reach.
            value, i = min((best[i], -i) for _, i in queue)
            best[j], before[j] = value, -i
            break
        value, i = queue[0]
        value += window - here
        while exact_j[k] == j:
            if best[exact_i[k]] < value:
                value, i = best[exact_i[k]], exact_i[k]
            k += 1
        value += costs[j]
        best[j], before[j] = value, i
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], last
    while j:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def tail_cuts(length: int, window: int) -> list[int]:
    """Lengths for what is left at a range's end: one padded sequence, or powers of two and a rest,
    whichever has the least padding plus penalties of the cuts."""
    choices, cost, head, left = [], 0.0, [], length
    while left:
        choices.append((cost + padding(left, window), len(head), head + [left]))
        part = 1 << (left.bit_length() - 1)
        if part == left:
            break
        head, left, cost = head + [part], left - part, cost + HARD_PENALTY
    return min(choices)[2] if choices else []


class RangePacker:
    """Packs one range of documents, in order; emits (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, dtype: np.dtype, end_ids: np.ndarray, block: int = BLOCK_TOKENS):
        self.window, self.dtype, self.end_ids, self.block = window, dtype, end_ids, max(block, 2 * window)
        self.docs: list[list] = []  # [doc_id, ids not yet packed, tokens packed, tokens in all]
        self.held, self.sequence = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.held += len(ids)
        return self._solve(False) if self.held >= self.block else []

    def finish(self) -> list[tuple]:
        return self._solve(True)

    def _solve(self, final: bool) -> list[tuple]:
        out: list[tuple] = []
        while self.held and (final or self.held >= self.block):
            stream = np.concatenate([d[1] for d in self.docs])
            total = min(len(stream), 4 * self.block)  # a very long document goes in several rounds
            part = stream[:total]
            ends = np.cumsum([len(d[1]) for d in self.docs])
            at, penalty = candidates(np.flatnonzero(np.isin(part, self.end_ids)) + 1, ends[ends <= total], total, self.window)
            if not len(at) or at[-1] != total:
                at, penalty = np.append(at, total), np.append(penalty, HARD_PENALTY)
            cuts = best_cuts(at, penalty, self.window)
            lengths = np.diff([0, *cuts]).tolist()
            rest = lengths.pop()
            if final and total == len(stream):
                lengths += tail_cuts(rest, self.window)
            out += self._emit(lengths)
        return out

    def _emit(self, lengths: list[int]) -> list[tuple]:
        out, k = [], 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc = self.docs[k]
                n = min(length - offset, len(doc[1]))
                piece = doc[1][:n]
                out.append((doc[0], doc[2], n, zlib.crc32(piece.astype("<u4").tobytes()), doc[3], self.sequence, offset))
                doc[1], doc[2], offset = doc[1][n:], doc[2] + n, offset + n
                if not len(doc[1]):
                    k += 1
            self.sequence += 1
            self.held -= length
        self.docs = self.docs[k:]
        return out


_FIELDS = "doc_id start length ids_crc32 doc_tokens local offset".split()


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, rows_per_range: int = ROWS_PER_RANGE, bytes_per_range: int = BYTES_PER_RANGE, block: int = BLOCK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Ranges of ids are packed each in one task; sequence numbers follow the ranges' order."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        dtype = encode.dtype
        end = np.array([end_id], dtype)
        vocab = encode.library.get_vocab(with_added_tokens=True)
        stops = [v for k, v in vocab.items() if k.removesuffix("</w>") in SENTENCE_ENDS]
        packer = RangePacker(window, dtype, np.array(sorted(stops), dtype), block)
        shard = TaskContext.get().partitionId()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *columns], names=["shard", *_FIELDS])

        for batch in batches:
            texts = encode.stream(text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts):
                rows = packer.add(doc_id, np.concatenate((np.frombuffer(ids, dtype), end)))
                if rows:
                    yield batch_of(rows)
        rows = packer.finish()
        if rows:
            yield batch_of(rows)

    rows = by_id_ranges(docs, rows_per_range, bytes_per_range, id_column, text_column)
    pieces = written(rows.mapInArrow(tidied(packed), "shard bigint, " + ", ".join(f"{f} bigint" for f in _FIELDS)), "packed-pieces")
    # Sequences of the ranges before: a row for each range only.
    ranges = pieces.groupBy("shard").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return pieces.join(ranges, "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).cast("bigint").alias("sequence_id"), "offset"
    )
