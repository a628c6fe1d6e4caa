"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words of letters and digits. A seed is a run of SEED words. Seeds that a
document shares with a benchmark item make the pair a candidate. For a candidate the longest
runs of words that both hold, and that are not marked yet, are found by running Karp-Rabin
hashes at lengths from long to short; they are marked in both, and so on down to the least
length. The verdict is the share of the item's words that are marked, so passages whose
sentences come in another order are caught as well as whole ones.

The benchmark is sent to all tasks only while its size is below a bound that is checked;
beyond it, seeds are joined by a shuffle in which frequent seeds and items are salted, and a
document travels once for each ITEMS_PER_ROW items that it meets. Both ways judge rows, not
ids: the rows of a join are named by a hash of id and text.

A document's places of a length are kept once, not once for each place of the item, so memory
follows the document's length also where one word is repeated throughout.

Defined cases: null and empty texts meet nothing; items with fewer words than a seed are
matched whole, as one seed of their own length; repeated documents are judged each, and so are
rows that share an id (or have none) with different texts; repeated items are found each, items
without an id as null; extra columns are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written
from brindle.llm.groups import tidied
from brindle.llm.shingles import mixed

SEED = 5
LEAST_MATCH = 5
COVERAGE = 0.6
BROADCAST_BYTES = 16 << 20
SALTS, ITEMS_PER_ROW = 16, 64

WORDS = re.compile(r"[^\W_]+")
_BASE = 0xBF58476D1CE4E5B9
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes, modulo 2**64, of all windows of a short length: the polynomial is built up for all windows at once."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    words = mixed(codes.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(_BASE) + words[k : k + n]
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Karp-Rabin hashes of the windows of any length of a list of words, from prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.busy = codes, np.zeros(len(codes), bool)
        self.inverse = _powers(_INVERSE, len(codes))
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=self.prefix[1:])

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the windows of a length that hold no marked word, ascending."""
        n = len(self.codes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate(([0], np.cumsum(self.busy)))
        at = np.flatnonzero(marked[length:] == marked[:n])
        with np.errstate(over="ignore"):
            return at, (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]


def tiles(item: Iterable[int], doc: Iterable[int], least: int = LEAST_MATCH, starts: Iterable[int] | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item position, document position, length), longest first, none overlapping. Codes of words
    are positive; 0 in the document is a word that no item holds.

    starts: places of the document around which common runs can lie (all, if not given)."""
    item, doc = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    near = _near(starts, len(doc), len(item), least)
    a, b = Rolling(item), Rolling(np.where(near >= 0, doc[near], 0) if len(near) else np.zeros(0, np.int64))
    found: list[tuple[int, int, int]] = []
    length = min(len(item), len(near))
    while length >= least:
        length = _longest(a, b, least, length)
        if not length:
            break
        marked = _mark(a, b, length)
        found += [(i, int(near[j]), length) for i, j in marked]
        length -= not marked  # only where windows that differ have one hash
    return found


def _near(starts: Iterable[int] | None, n_doc: int, n_item: int, least: int) -> np.ndarray:
    """Places of the document within an item's length of the starts, with a -1 between stretches."""
    if starts is None:
        return np.arange(n_doc)
    s = np.unique(np.asarray(starts, np.int64))
    if not len(s):
        return s
    first, last = np.maximum(s - n_item, 0), np.minimum(s + n_item + least, n_doc)
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    ends = last[np.append(new[1:] - 1, len(s) - 1)]
    out = []
    for x, y in zip(first[new].tolist(), ends.tolist()):
        out += [np.arange(x, y), np.array([-1])]
    return np.concatenate(out[:-1])


def _longest(a: Rolling, b: Rolling, least: int, most: int) -> int:
    """The greatest length at which unmarked runs match, 0 if none; by bisection, as a run holds runs of every shorter length."""

    def match(length: int) -> bool:
        return bool(np.isin(b.free(length)[1], a.free(length)[1]).any())

    if not match(least):
        return 0
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        if match(mid):
            low = mid
        else:
            high = mid - 1
    return low


def _mark(a: Rolling, b: Rolling, length: int) -> list[tuple[int, int]]:
    """Mark the matching runs of a length, earliest in the item and then in the document first; those marked."""
    (at_a, hash_a), (at_b, hash_b) = a.free(length), b.free(length)
    met = np.isin(hash_b, hash_a)
    at_b, hash_b = at_b[met], hash_b[met]
    order = np.argsort(hash_b, kind="stable")
    at_b, hash_b = at_b[order], hash_b[order]
    low, high = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
    done: dict[int, int] = {}  # first place of each hash that may be free
    out = []
    for k in np.flatnonzero(low < high).tolist():
        i = int(at_a[k])
        if a.busy[i : i + length].any():
            continue
        p = done.get(int(low[k]), int(low[k]))
        while p < high[k] and b.busy[at_b[p] : at_b[p] + length].any():
            p += 1
        done[int(low[k])] = p
        for j in at_b[p : high[k]].tolist():
            if not b.busy[j : j + length].any() and np.array_equal(a.codes[i : i + length], b.codes[j : j + length]):
                a.busy[i : i + length] = b.busy[j : j + length] = True
                out.append((i, j))
                break
    return out


class Benchmark:
    """Seeds of the items, and the tiling of documents that share some."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = SEED, least: int = LEAST_MATCH):
        self.least = least
        self.code: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray, int, np.ndarray]] = []  # id, words, length and hashes of seeds
        for item_id, text in items:
            words = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words_of(text or "")], np.int64)
            if len(words):
                length = min(seed, len(words))
                self.items.append((item_id, words, length, window_hashes(words, length)))
        #: For each length of seeds: sorted hashes; the items of each, one after another, and where they begin.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({n for _, _, n, _ in self.items}):
            own = [(k, np.unique(h)) for k, (_, _, n, h) in enumerate(self.items) if n == length]
            hashes = np.concatenate([h for _, h in own])
            owners = np.repeat([k for k, _ in own], [len(h) for _, h in own])
            order = np.argsort(hashes, kind="stable")
            known, begin = np.unique(hashes[order], return_index=True)
            self.seeds[length] = known, owners[order], np.append(begin, len(order))

    def matches(self, text: str, coverage: float) -> list[tuple[int | None, float, int, int]]:
        """(item_id, coverage, marked words, longest run) of the items whose words are covered enough."""
        get = self.code.get
        words = words_of(text)
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        out = []
        for length, (known, owners, begin) in self.seeds.items():
            hashes = window_hashes(codes, length)
            if not len(hashes):
                continue
            places = np.searchsorted(known, hashes)
            places[places == len(known)] = 0
            hit = np.flatnonzero(known[places] == hashes)
            if not len(hit):
                continue
            met = np.unique(places[hit])
            for k in np.unique(np.concatenate([owners[begin[s] : begin[s + 1]] for s in met.tolist()])).tolist():
                item_id, item, _, own = self.items[k]
                least = min(self.least, len(item))
                shared = np.isin(own, known[met])
                # Every run of the least length begins with a seed where seeds are no longer than it: no need to tile
                # an item whose shared seeds lie on too few of its words.
                if length <= least and _covered(shared, max(length, 1), len(item)) < coverage * len(item):
                    continue
                found = tiles(item, codes, least, hit[np.isin(hashes[hit], own)])
                marked = sum(n for _, _, n in found)
                if found and marked >= coverage * len(item):
                    out.append((item_id, marked / len(item), marked, max(n for _, _, n in found)))
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def _covered(begins: np.ndarray, length: int, n: int) -> int:
    """Words that lie in a window of that length which begins at a marked place."""
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


_SCHEMA = "item_id bigint, coverage double, marked_words bigint, longest_run bigint"


def _batch(names: list[str], keys: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of integers that name a document, and what was found in it."""
    kinds = [pa.int64()] * len(names) + [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    columns = list(zip(*(k + r for k, r in zip(keys, rows)))) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*names, "item_id", "coverage", "marked_words", "longest_run"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _size(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]


def _row_key() -> Column:
    """A name for rows of equal id and text, whose verdicts are equal."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, least: int = LEAST_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, marked_words, longest_run) for each pair with enough of the item covered."""
    items, texts = _items(benchmark), _texts(docs)
    if _size(items) <= broadcast_bytes:
        return _by_broadcast(texts, [(r.item_id, r.text) for r in items.collect()], coverage, seed, least)
    return _by_join(texts, items, coverage, seed, least).drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, least: int = LEAST_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that cover no item, with docs' columns. Without a shuffle while the benchmark is small."""
    items = _items(benchmark)
    if _size(items) > broadcast_bytes:
        bad = _by_join(_texts(docs), items, coverage, seed, least).select(F.col("key").alias("__leak_key"), F.col("doc_id").alias("__leak_id")).distinct()
        keyed = docs.withColumn("__row_key", _row_key())
        same = (keyed["__row_key"] == bad["__leak_key"]) & keyed["doc_id"].cast("bigint").eqNullSafe(bad["__leak_id"])
        return keyed.join(bad, same, "left_anti").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value, seed, least)
        for batch in batches:
            yield batch.filter(pa.array([not bench.matches(x.as_py() or "", coverage) for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidied(keep), docs.schema)


def _by_broadcast(texts: DataFrame, items: list[tuple[int | None, str]], coverage: float, seed: int, least: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value, seed, least)
        for batch in batches:
            keys, rows = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in bench.matches(text.as_py(), coverage):
                    keys.append((doc_id,))
                    rows.append(row)
            if rows:
                yield _batch(["doc_id"], keys, rows)

    return texts.mapInArrow(tidied(find), f"doc_id bigint, {_SCHEMA}")


def _seeds(texts: DataFrame, key: str, lengths: list[int] | None, seed: int) -> DataFrame:
    """(key, seed, n) of texts (key, text): the different windows of the given lengths, or those an item of that many words takes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, sizes = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = [w.encode() for w in words_of(text.as_py())]
                codes = np.array([zlib.crc32(w) | len(w) << 32 for w in data], np.int64)
                for n in lengths or [min(seed, len(data))]:
                    found = np.unique(window_hashes(codes, n)) if n else ()
                    if len(found):
                        out.append(mixed(found ^ np.uint64(n)).view(np.int64))
                        keys.append(np.full(len(found), k))
                        sizes.append(np.full(len(found), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, out, sizes)], names=[key, "seed", "n"])

    return texts.mapInArrow(tidied(cut), f"{key} bigint, seed bigint, n bigint")


def _salted(large: DataFrame, small: DataFrame, on: str, spread: str) -> DataFrame:
    """Inner join in which a value of `on` that many rows of `large` hold is dealt over SALTS tasks by `spread`."""
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    return large.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), spread), F.lit(SALTS)).cast("int")).join(small.withColumn("salt", salts), [on, "salt"]).drop("salt")


def _by_join(texts: DataFrame, items: DataFrame, coverage: float, seed: int, least: int) -> DataFrame:
    """For a benchmark of any size: (doc_id, key, found). Seeds meet in a shuffle, then the items that a row meets are
    tiled, ITEMS_PER_ROW at a time."""
    own = texts.withColumn("key", _row_key())  # different rows that share a key only widen the candidates
    items = items.withColumn("item_key", F.xxhash64("item_id", "text"))
    of_items = written(_seeds(items.select("item_key", "text"), "item_key", None, seed).distinct(), "item-seeds")
    lengths = sorted(r.n for r in of_items.select("n").distinct().collect())  # at most `seed` numbers
    of_docs = _seeds(own.select("key", "text"), "key", lengths or [seed], seed)
    pairs = written(_salted(of_docs.select("key", "seed"), of_items.select("item_key", "seed"), "seed", "key").select("key", "item_key").distinct(), "seed-pairs")
    rows_of = pairs.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_PER_ROW).alias("parts"))
    dealt = _salted(pairs, items.withColumnRenamed("text", "item_text"), "item_key", "key").join(rows_of, "key")
    dealt = dealt.groupBy("key", F.pmod(F.xxhash64("item_key"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("met"))
    joined = dealt.join(own, "key").select("doc_id", "key", "text", "met")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for r in batch.to_pylist():
                for row in Benchmark([(m["item_id"], m["item_text"]) for m in r["met"]], seed, least).matches(r["text"], coverage):
                    keys.append((r["doc_id"], r["key"]))
                    rows.append(row)
            if rows:
                yield _batch(["doc_id", "key"], keys, rows)

    return joined.mapInArrow(tidied(tile), f"doc_id bigint, key bigint, {_SCHEMA}")
