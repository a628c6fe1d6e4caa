"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken starts as one symbol per UTF-8 byte, in a doubly linked list. A heap holds
the adjacent pairs that the vocabulary can merge, by (rank, position). The lowest is
popped, checked against the list (a pair whose symbols have changed is stale and is
dropped) and merged, and its two new neighbours are pushed. The count is the number of
initial symbols minus the number of merges: no identifiers are made.

Texts split into pretokens that never share a merge, so a count is a sum over pretokens.
Each Python worker remembers the counts of pretokens it has met, up to a fixed number of
them; the memory is a cache and never changes a count.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows
are counted each; other columns pass by untouched; special strings inside a text are one
token each, as the tokenizer's file declares them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm.groups import tidied

# Fixed values of the byte-level scheme: the pretoken pattern and the printable bytes that stand for themselves.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

MAX_REMEMBERED, LONGEST_REMEMBERED = 500_000, 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable bytes are themselves, the others follow from 256 on."""
    plain = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under the merge ranks of a byte-level BPE file."""

    def __init__(self, path: str, max_remembered: int = MAX_REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        ids = {symbols[b]: b for b in range(256)}
        #: (left symbol, right symbol) -> (rank, merged symbol); symbols are small integers.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = ids.setdefault(left + right, len(ids))
            self.merges.setdefault(ids[left] << 20 | ids[right], (rank, new))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.special_strings = specials
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.max_remembered = max_remembered
        self.by_pretoken: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def merge_count(self, pretoken: bytes) -> int:
        """Symbols left once no adjacent pair can be merged."""
        n = len(pretoken)
        if n == 1:
            return 1
        get = self.merges.get
        symbol = list(pretoken)
        heap = []
        for i in range(n - 1):
            found = get(symbol[i] << 20 | symbol[i + 1])
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, a, b, new = pop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = get(new << 20 | symbol[k])
                if found:
                    push(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = get(symbol[h] << 20 | new)
                if found:
                    push(heap, (found[0], h, symbol[h], new, found[1]))
        return left

    def _pretokens(self, text: str) -> int:
        known, total = self.by_pretoken, 0
        for piece in self.pattern.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.merge_count(piece.encode("utf-8"))
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(known) >= self.max_remembered:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        """Text without special strings. Words parted by one space each are counted chunk by chunk:
        a pretoken takes at most the one space before it, so no pretoken crosses such a cut."""
        chunks = text.split(" ")
        if len(chunks) < 2:
            return self._pretokens(text) if text else 0
        known = self.by_chunk
        rest = chunks[1:]
        counts = list(map(known.get, rest))
        if None in counts:
            long: dict[str, int] = {}  # of this text alone: what is remembered is bounded in length, too
            for c in set(c for c, n in zip(rest, counts) if n is None):
                if not c or c[0].isspace() or c[-1].isspace() or c[0] in "\x1c\x1d\x1e\x1f":
                    return self._pretokens(text)  # runs of white space: cut by the pattern alone
                if len(known) >= self.max_remembered:
                    known.clear()
                (known if len(c) <= LONGEST_REMEMBERED else long)[c] = self._pretokens(" " + c)
            counts = [long[c] if c in long else known[c] if c in known else self._pretokens(" " + c) for c in rest]
        first = chunks[0]
        if not first or first[-1].isspace():
            return self._pretokens(text)
        return self._pretokens(first) + sum(counts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.special_strings):
            return self._plain(text)
        specials = len(self.special.findall(text))
        return specials + sum(self._plain(x) for x in self.special.split(text) if x)


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary file and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    vocabulary is the path of a byte-level BPE file that every executor can read. Nothing
    is shuffled; a worker holds one text at a time besides its cache.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(count(text))
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(id_column, text_column).mapInArrow(tidied(counted), schema)
