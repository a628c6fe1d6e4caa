"""Substring dedup by paragraph MinHash banding.

Passages repeat inside other text, so paragraphs are not taken from line ends: a paragraph is a run
of SIZE words that begins where winnowing puts it, at the least shingle of each run of STEP
positions. Two texts that share SIZE + STEP - 1 words or more share a paragraph for certain,
wherever the passage lies in them.

Each paragraph gets bands of MinHash values of its shingles. Paragraphs that collide in a band are
joined: equal ones are one by their hash, others are verified by the exact Jaccard similarity of
their shingles. A band of over LARGE paragraphs is dealt out in cells of two blocks, so that no task
holds a group of unbounded size and no pair of a band is dropped. Verified links are clustered by connected components; of each cluster the
first occurrence (least doc_id, then place) stays and the others are removals.

Bands are tuned to the threshold: as many bands of ROWS values as it takes to meet a pair at the threshold with RECALL
(three bands of two values: 1 - (1 - 0.8**2)**3 = 0.953); equal paragraphs meet for certain. A passage of a hundred words
holds about seven paragraphs, each with its own chance.

Paragraphs alone would miss the ends of a passage. So texts are also winnowed for seeds, runs of SEED words of which
any SEED + SEED_STEP - 1 = 22 equal words hold one. Seeds that occur again, in a row, are a run; each run
is compared word by word with the first occurrences of its ends and goes on to both sides as far as the words agree, and past edits of
up to GAP words while the whole passage keeps a similarity of at least the threshold (over the places of its shingles; it
begins and ends with a shared shingle, within CONTEXT words of a run). Passages of at least SIZE words are reported and cut
whole. At 0.8 a passage of n words with changed words has at most (n - 4) / 45 edits inside, so one of its agreeing
stretches has 22 words or more and holds a seed: nothing is left to the chance of the bands. A seed is compared with
its first occurrence only.

Defined cases: null, blank and shorter texts hold no paragraph and stay as they are; rows are judged, not ids: rows
without doc_id, and rows that share one, are documents of their own and come last in the order of occurrences (they
are named by a hash of id and text inside); of rows of one id and one text all but one go whole, if the text has SIZE words; a
removal is made only in a text that holds the paragraph at that place; an empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.components import components
from brindle.llm.groups import dealt, forest, in_cells, recurring, similar, tidied
from brindle.llm.shingles import SHINGLE, batched, coefficients, mixed, windows, windows_at, words

SIZE, STEP = 24, 26
# A step is shorter than a seed, so the seeds of a stretch of equal words leave no word between them.
SEED, SEED_STEP, AROUND, CONTEXT, GAP = 12, 11, 10, 48, 8
SEED_PARTS = 3  # seeds are looked up a part at a time, which bounds the disk that their shuffle takes
THRESHOLD, RECALL, ROWS = 0.8, 0.95, 2
LARGE, BLOCK = 2048, 512
FEW = 24  # members of a cell up to which sets are compared one by one
NO_IDS = 1 << 62  # rows without an id of their own are named from here on


def bands_for(threshold: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands by which a pair at the threshold meets with at least that chance."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold**rows) - 1e-9))


def places(shingles: np.ndarray, size: int, step: int, shingle: int) -> np.ndarray:
    """Word positions at which paragraphs begin: the rightmost least shingle of each run of `step` positions."""
    n = len(shingles) - (size - shingle)
    if n <= 0:
        return np.zeros(0, np.int64)
    keys, best, have = shingles[:n], np.arange(n), 1
    while have < min(n, step):  # the best place of runs of `have` positions, doubled
        by = min(have, min(n, step) - have)
        left, right = best[: len(best) - by], best[by:]
        best = np.where(keys[right] <= keys[left], right, left)
        have += by
    return np.unique(best)


def places_of_texts(shingles: np.ndarray, offsets: np.ndarray, size: int, step: int) -> np.ndarray:
    """places() of texts whose words follow each other: ascending word positions. shingles: of all words, those that reach into
    the next text included; offsets: of the texts' first words, with the number of words last."""
    n = np.maximum(np.diff(offsets) - (size - 1), 0)  # places at which a paragraph of each text can begin
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    # Texts are laid out with `step` greatest keys behind each, so that no run of places reaches the next text.
    word = np.arange(total) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    laid = np.arange(total) + np.repeat(step * np.arange(len(n)), n)
    keys = np.full(total + step * len(n), np.iinfo(np.uint64).max, np.uint64)
    keys[laid] = shingles[word]
    best, have = np.arange(len(keys)), 1
    while have < step:
        by = min(have, step - have)
        left, right = best[: len(best) - by], best[by:]
        best = np.where(keys[right] <= keys[left], right, left)
        have += by
    first = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    inside = np.arange(total) - first  # place within its text
    runs = np.repeat(np.maximum(n - step + 1, 1), n)  # runs of a text: one, if it is shorter
    chosen = np.unique(best[laid[inside < runs]])
    return word[np.searchsorted(laid, chosen)]


class Paragraphs:
    def __init__(self, size: int = SIZE, step: int = STEP, shingle: int = SHINGLE, bands: int = bands_for(THRESHOLD), rows: int = ROWS):
        self.size, self.step, self.shingle, self.bands, self.rows = size, step, shingle, bands, rows
        self.a, self.b = coefficients(bands * rows, 2)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, bands) of the paragraphs of a text; start in words, bands a row for each."""
        hashes = words(text)[2]
        return self.of_words(hashes, np.array([0, len(hashes)]))

    def of_words(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts whose words follow each other; start counts from the first word of the first text."""
        if len(hashes) < self.size:
            none = np.zeros(0, np.int64)
            return none, none, none.reshape(0, self.bands)
        shingles = windows(hashes, self.shingle)
        at = places_of_texts(shingles, offsets, self.size, self.step)
        whole = windows_at(hashes, at, self.size).view(np.int64)
        out = np.zeros((len(at), self.bands), np.uint64)
        folded = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        for part in range(0, len(at), 2048):  # the shingles of so many paragraphs at a time, a paragraph in a column
            x = folded[np.arange(self.size - self.shingle + 1)[:, None] + at[part : part + 2048]]
            bands = out[part : part + 2048]
            with np.errstate(over="ignore"):
                for k in range(self.bands * self.rows):
                    least = (x * self.a[k] + self.b[k]).min(axis=0).astype(np.uint64)
                    band = k // self.rows
                    bands[:, band] = mixed(bands[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band + 1))
        return at, whole, out.view(np.int64)


def _texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).to_pylist()]


def occurrences(docs: DataFrame, parts: Paragraphs) -> DataFrame:
    """(doc_id, start, paragraph, band_0, band_1, ...) of every paragraph of every text."""
    names = [f"band_{k}" for k in range(parts.bands)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, hashes, offsets in batched(_texts_of(batch)):
                at, whole, bands = parts.of_words(hashes, offsets)
                text = np.searchsorted(offsets, at, "right") - 1
                columns = [ids[first + text], (at - offsets[text]).astype(np.int32), whole, *(np.ascontiguousarray(bands[:, k]) for k in range(parts.bands))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "paragraph", *names])

    return _texts(docs).mapInArrow(tidied(cut), "doc_id bigint, start int, paragraph bigint, " + ", ".join(f"{n} bigint" for n in names))


def _shared_ids(docs: DataFrame) -> DataFrame | None:
    """(shared): ids of several rows, and null if there are rows without one; None if each row has an id of its own."""
    found = docs.groupBy(F.col("doc_id").alias("shared")).agg(F.count("*").alias("n")).filter("n > 1 or shared is null").select("shared")
    return None if found.isEmpty() else found


def _named(docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """docs with __row: a row's own id, or where that is shared or absent a name made of id and text, behind all ids. Rows of one id
    and one text have one name, and are no different rows."""
    if shared is None:
        return docs.withColumn("__row", F.col("doc_id").cast("bigint"))
    made = F.xxhash64(F.col("doc_id"), F.col("text").cast("binary")).bitwiseAND(F.lit(NO_IDS - 1)) + F.lit(NO_IDS)
    rows = docs.join(shared.withColumn("__shared", F.lit(True)), docs["doc_id"].eqNullSafe(F.col("shared")), "left")
    return rows.withColumn("__row", F.when(F.col("__shared"), made).otherwise(F.col("doc_id").cast("bigint"))).drop("shared", "__shared")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of rows whose doc_id is a name of their own."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def distinct_paragraphs(found: DataFrame, size: int) -> DataFrame:
    """(paragraph, band_0, band_1, ..., doc_id, start, again): each different paragraph with its least document and a place; again: it
    occurs at two places that are in different documents or do not overlap. Plain numbers only, which are aggregated without a sort."""
    bands = [c for c in found.columns if c.startswith("band_")]
    # Equal paragraphs have equal bands, so the least of each are theirs.
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "start") for n, f in (("a", F.min), ("b", F.max))]
    g = found.groupBy("paragraph").agg(*[F.min(c).alias(c) for c in bands], *ends)
    again = (F.col("a_doc_id") != F.col("b_doc_id")) | (F.col("b_start") >= F.col("a_start") + size)
    return g.select("paragraph", *bands, F.col("a_doc_id").alias("doc_id"), F.col("a_start").alias("start"), again.alias("again"))


def apart(first, last, size: int):
    """True if two places are in different documents or do not overlap."""
    return (last["doc_id"] != first["doc_id"]) | (last["start"] >= first["start"] + size)


def collisions(distinct: DataFrame, size: int) -> list[DataFrame]:
    """Written tables (band, paragraph) of the different paragraphs that share a band with another one elsewhere, a table for each
    band, so that no more than one of them is shuffled at a time. Neighbours in one text, which overlap, do not count by
    themselves: they repeat only as that text's passage repeats."""
    out = []
    for name in (c for c in distinct.columns if c.startswith("band_")):
        rows = distinct.select(F.col(name).alias("band"), "paragraph", "doc_id", "start").repartition("band")  # one shuffle for both uses
        bounds = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "start") for n, f in (("a", F.min), ("b", F.max))]
        shared = rows.groupBy("band").agg(*bounds)
        shared = shared.filter((F.col("a_doc_id") != F.col("b_doc_id")) | (F.col("b_start") >= F.col("a_start") + size)).select("band")
        out.append(written(rows.select("band", "paragraph").join(shared.hint("shuffle_hash"), "band"), "band-members"))
    return out


def shingle_lists(docs: DataFrame, wanted: DataFrame, parts: Paragraphs) -> DataFrame:
    """(paragraph, shingles) of the wanted paragraphs (paragraph, doc_id), from the texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = [], []
            wanted_of = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())))
            wanted_all = batch.column(1).flatten().to_numpy()
            for first, hashes, offsets in batched([t or b"" for t in batch.column(0).to_pylist()]):
                asked = np.unique(wanted_all[wanted_of[first] : wanted_of[first + len(offsets) - 1]])
                if len(hashes) < parts.size or not len(asked):
                    continue
                shingles, whole = windows(hashes, parts.shingle), windows(hashes, parts.size).view(np.int64)
                at = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, whole), len(asked) - 1)] == whole)
                at = at[at + parts.size <= offsets[np.searchsorted(offsets, at, "right")]]  # inside one text
                found, one = np.unique(whole[at], return_index=True)
                own = np.sort(shingles[at[one, None] + np.arange(parts.size - parts.shingle + 1)], axis=1)
                again = (own[:, 1:] == own[:, :-1]).any(axis=1).tolist()
                names += found.tolist()
                lists += [(np.unique(x) if twice else x).tobytes() for x, twice in zip(own, again)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lists, pa.binary())], names=["paragraph", "shingles"])

    # A document's wanted paragraphs are bounded by its own length.
    of_doc = wanted.groupBy("doc_id").agg(F.collect_list("paragraph").alias("paragraphs"))
    rows = _texts(docs).join(of_doc.hint("shuffle_hash"), "doc_id").select("text", "paragraphs")  # texts are not sorted
    return rows.mapInArrow(tidied(cut), "paragraph bigint, shingles binary").dropDuplicates(["paragraph"])


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(names, lists) of each cell, from batches (cell, name, list) sorted by cell."""
    cell, names, lists = None, [], []
    for batch in batches:
        cells, own, held = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if names and cells[x] != cell:
                yield names, lists
                names, lists = [], []
            cell = cells[x]
            names, lists = names + own[x:y], lists + held[x:y]
    if names:
        yield names, lists


def few_edges(sets: list[frozenset], threshold: float) -> list[tuple[int, int]]:
    """forest() of a few sets that are similar, compared one by one."""
    left, out = list(range(len(sets))), []
    while left:
        queue = [left.pop(0)]
        while queue and left:
            i, rest = queue.pop(), []
            for j in left:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    out.append((i, j))
                    queue.append(j)
                else:
                    rest.append(j)
            left = rest
    return out


def near_edges(pairs: DataFrame, lists: DataFrame, threshold: float, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(a, b) of paragraphs with a similarity of at least the threshold: a spanning forest of each cell.
    pairs: band, paragraph; lists: paragraph, shingles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for names, lists in members_of(batches):
            n = len(names)
            if n < 2:
                continue
            sets = [np.frombuffer(s, "<u8") for s in lists]
            if n <= FEW:
                edges = few_edges([frozenset(x.tolist()) for x in sets], threshold)
            else:
                near = similar(sets, threshold)
                edges = forest(n, lambda i, others: near[i, others])
            a += [names[i] for i, _ in edges]
            b += [names[j] for _, j in edges]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # Groups are counted and dealt out before their shingles are fetched.
    sizes = pairs.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    table = written(pairs.join(sizes, "band"), "collisions")
    whole = table.withColumn("members", F.when(F.col("members") > large, F.col("members")).otherwise(1))
    cells = dealt(whole, "band", "members", "paragraph", block).select("cell", "paragraph")
    cells = cells.join(lists, "paragraph").select("cell", "paragraph", "shingles")
    out = written(in_cells(cells, compare, "a bigint, b bigint").distinct(), "near-edges")
    discard(table)
    return out


def repeated(found: DataFrame, distinct: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, start, paragraph, ref_doc, ref_start, kept, words) of the occurrences of clusters at two places or more. A paragraph
    that is linked to no other is a cluster of its own. ref: the first occurrence of the cluster, which is kept, with what
    overlaps it in its text."""
    named = distinct.filter("again").select("paragraph").join(labels.withColumnRenamed("vertex", "paragraph"), "paragraph", "full")
    named = named.select("paragraph", F.coalesce("component", "paragraph").alias("cluster"))
    rows = written(found.select("doc_id", "start", "paragraph").join(named.hint("shuffle_hash"), "paragraph"), "cluster-places")
    at = F.struct("doc_id", "start")
    of = rows.groupBy("cluster").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter(apart(F.col("first"), F.col("last"), size))
    here = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") < F.col("first.start") + size)
    # A kept place stands for itself.
    ref = lambda c: F.when(here, F.col(c)).otherwise(F.col(f"first.{c}"))
    out = rows.join(of.hint("shuffle_hash"), "cluster").select("doc_id", "start", "paragraph", ref("doc_id").alias("ref_doc"), ref("start").alias("ref_start"), here.alias("kept"), F.lit(size).alias("words"))
    out = written(out, "duplicates")
    discard(rows)
    return out


def _key(text: bytes) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(text))))


def surroundings(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two bits of each of the AROUND words before and behind the seeds at these places, nearest word lowest."""
    bits, out = np.concatenate((np.zeros(AROUND, np.uint64), hashes >> np.uint64(62), np.zeros(AROUND, np.uint64))), np.zeros(len(at), np.uint64)
    for k in range(AROUND):
        out |= bits[at + AROUND - 1 - k] << np.uint64(2 * k)
        out |= bits[at + AROUND + SEED + k] << np.uint64(2 * (AROUND + k))
    return out.view(np.int64)


def agreeing_around(a: Column, b: Column) -> Column:
    """Words that agree around two seeds, by their surroundings, at most AROUND on each side; never too few."""
    differ = a.bitwiseXOR(b)
    mask = lambda k, by: F.lit(((1 << 2 * k) - 1) << by)
    return sum((F.when(differ.bitwiseAND(mask(k, by)) == 0, 1).otherwise(0) for by in (0, 2 * AROUND) for k in range(1, AROUND + 1)), F.lit(0))


TEXT_BITS = 4 * AROUND  # from here on a few bits of the text itself, which part texts of one id


def seeds(docs: DataFrame, least: int, shingle: int) -> DataFrame:
    """(doc_id, start, seed, around) of the seeds of every text that can hold a passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), _texts_of(batch)
            tags = np.array([_key(t) for t in texts], np.int64) & ((1 << (63 - TEXT_BITS)) - 1)
            for first, hashes, offsets in batched(texts):
                if len(hashes) < least:
                    continue
                at = places_of_texts(windows(hashes, shingle), offsets, SEED, SEED_STEP)
                text = np.searchsorted(offsets, at, "right") - 1
                at, text = (x[(np.diff(offsets) >= least)[text]] for x in (at, text))
                columns = [ids[first + text], (at - offsets[text]).astype(np.int32), windows_at(hashes, at, SEED).view(np.int64), surroundings(hashes, at) | tags[first + text] << TEXT_BITS]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "seed", "around"])

    return _texts(docs).mapInArrow(tidied(cut), "doc_id bigint, start int, seed bigint, around bigint")


def repeated_seeds(found: DataFrame) -> DataFrame:
    """(doc_id, text, start, place) of seeds that occurred before, place: r_doc, r_start, seed of the first occurrence. Only seeds in
    a stretch of SEED + AROUND words or more that agree: every passage holds one of those."""
    # Plain numbers first, which say what repeats at all; the place of the first occurrence is looked up among that. The seeds are
    # dealt once for all of it, and looked up by hash, as most occur once and need no sort.
    found = found.repartition("seed")
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "start") for n, f in (("a", F.min), ("b", F.max))]
    again = found.groupBy("seed").agg(*ends).filter((F.col("a_doc_id") != F.col("b_doc_id")) | (F.col("b_start") >= F.col("a_start") + SEED))
    rows = found.join(again.select("seed", F.col("a_doc_id").alias("least")).hint("shuffle_hash"), "seed")
    firsts = rows.filter("doc_id = least").groupBy("seed").agg(F.min(F.struct("doc_id", "start", "around")).alias("first"))
    rows = rows.join(firsts.hint("shuffle_hash"), "seed").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.start") + SEED))
    rows = rows.filter(agreeing_around(F.col("around"), F.col("first.around")) >= AROUND)
    place = F.struct(F.col("first.doc_id").alias("r_doc"), F.col("first.start").alias("r_start"), "seed")
    return rows.select("doc_id", F.shiftright("around", TEXT_BITS).alias("text"), "start", place.alias("place"))


def runs(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end, low, high): stretches of a text covered by seeds that occurred before, with the first occurrences of
    the first seed (low: r_doc, r_start, seed) and of the last one (high)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a text follow each other; of a run only its first row and its last are held.
        head = tail = None
        names = ["doc_id", "start", "end", "a_doc", "a_start", "a_seed", "z_doc", "z_start", "z_seed"]

        def told(a: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
            columns = [a[0], a[2].astype(np.int32), (z[2] + SEED).astype(np.int32), a[3], a[4].astype(np.int32), a[5], z[3], z[4].astype(np.int32), z[5]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if tail is not None:
                x = np.concatenate((tail, x), axis=1)
            new = (x[:2, 1:] != x[:2, :-1]).any(axis=0) | (x[2, 1:] > x[2, :-1] + SEED)
            cuts = np.flatnonzero(new) + 1
            first = np.concatenate(([0], cuts))
            heads, tail = x[:, first], x[:, -1:]
            if head is not None:
                heads[:, :1] = head
            if len(cuts):
                yield told(heads[:, :-1], x[:, cuts - 1])
            head = heads[:, -1:]
        if tail is not None:
            yield told(head, tail)

    flat = rows.select("doc_id", "text", "start", "place.*")
    order = flat.repartition("doc_id", "text").sortWithinPartitions(*flat.columns)
    found = order.mapInArrow(tidied(ends), "doc_id bigint, start int, end int, a_doc bigint, a_start int, a_seed bigint, z_doc bigint, z_start int, z_seed bigint")
    place = lambda k: F.struct(F.col(f"{k}_doc").alias("r_doc"), F.col(f"{k}_start").alias("r_start"), F.col(f"{k}_seed").alias("seed"))
    return found.select("doc_id", "start", "end", place("a").alias("low"), place("z").alias("high"))


def hold(hashes: np.ndarray, at: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """True where texts that end at these words have those seeds at these places."""
    inside = (at >= 0) & (at + SEED <= ends)
    inside[inside] = windows_at(hashes, at[inside], SEED).view(np.int64) == seeds[inside]
    return inside


def listed(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """(places, fields) of a column of lists of structs: where each row's structs begin in the fields, with their number last."""
    return np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy()))), column.flatten().flatten()


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(r_doc, r_start, seed, before, beside): the words (32 bits of each hash) before or behind the seeds at first occurrences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["r_doc", "r_start", "seed", "before", "beside"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            of, (start, seed, before) = listed(batch.column(2))
            docs_, start, seed, before = batch.column(0).to_numpy(), start.to_numpy(), seed.to_numpy(), before.to_numpy(zero_copy_only=False)
            for first, hashes, offsets in batched([t or b"" for t in batch.column(1).to_pylist()]):
                own = slice(of[first], of[first + len(offsets) - 1])
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(of[first : first + len(offsets)]))
                begin, end = offsets[text], offsets[text + 1]
                at = begin + start[own]
                right = np.flatnonzero(hold(hashes, at, end, seed[own]))
                left = before[own][right]
                a = np.where(left, np.maximum(begin[right], at[right] - CONTEXT), at[right] + SEED)
                z = np.where(left, at[right], np.minimum(end[right], at[right] + SEED + CONTEXT))
                low = hashes.astype(np.uint32)
                for column, found in zip(out, (docs_[first + text[right]], start[own][right], seed[own][right], left)):
                    column += found.tolist()
                out[4] += [low[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist())]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    of_text = wanted.groupBy("r_doc").agg(F.collect_list(F.struct("r_start", "seed", "before")).alias("w"))
    rows = of_text.hint("shuffle_hash").join(_texts(docs).withColumnRenamed("doc_id", "r_doc"), "r_doc").select("r_doc", "text", "w")
    found = rows.mapInArrow(tidied(cut), "r_doc bigint, r_start int, seed bigint, before boolean, beside binary")
    return found.dropDuplicates(["r_doc", "r_start", "seed", "before"])


def _agreeing(a: list[int], b: list[int], i: int, j: int) -> int:
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def reach(a: list[int], b: list[int], shingle: int = SHINGLE, gap: int = GAP) -> list[tuple[int, int, int]]:
    """Ends to which a run goes on in two texts, each behind an agreeing stretch: (words of a, words of b, shingles won).
    Edits of up to `gap` words are passed where a whole shingle agrees behind them."""
    n = _agreeing(a, b, 0, 0)
    out = [(n, n, n)]
    i = j = won = n
    while True:
        # A shingle can agree only where its first word does.
        near = set(b[j : j + gap + 1])
        firsts = [x for x, word in enumerate(a[i : i + gap + 1]) if word in near]
        if not firsts:
            return out
        # The fewest words passed by, then as many on either side as can be, then the fewest of a.
        ahead = [(x + y, abs(x - y), x) for x in firsts if i + x + shingle <= len(a) for y, word in enumerate(b[j : j + gap + 1]) if word == a[i + x] and a[i + x : i + x + shingle] == b[j + y : j + y + shingle]]
        if not ahead:
            return out
        t, _, x = min(ahead)
        n = _agreeing(a, b, i + x, j + t - x)
        i, j, won = i + x + n, j + t - x + n, won + n - shingle + 1
        out.append((i, j, won))


def extended(docs: DataFrame, found: DataFrame, least: int, threshold: float, shingle: int) -> DataFrame:
    """(doc_id, start, paragraph, ref_doc, ref_start, kept, words) of the passages that runs are part of, and of the ends of their first
    occurrences (one piece where both ends lie on one diagonal)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            of, fields = listed(batch.column(2))
            low_of, high_of = fields[2].flatten(), fields[3].flatten()
            docs_ = batch.column(0).to_numpy()
            start, stop, low_seed, high_seed = (c.to_numpy() for c in (fields[0], fields[1], low_of[2], high_of[2]))
            for first_text, hashes, offsets in batched([t or b"" for t in batch.column(1).to_pylist()]):
                own = slice(of[first_text], of[first_text + len(offsets) - 1])
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(of[first_text : first_text + len(offsets)]))
                begins, ends = offsets[text], offsets[text + 1]
                # A run of another text under this id is passed by.
                right = hold(hashes, begins + start[own], ends, low_seed[own]) & hold(hashes, begins + stop[own] - SEED, ends, high_seed[own])
                right = np.flatnonzero(right)
                low = hashes.astype(np.uint32)
                rows = pa.array(own.start + right)
                of_run = [c.take(rows).to_pylist() for c in (fields[0], fields[1], low_of[0], low_of[1], high_of[0], high_of[1], fields[4], fields[5])]
                for doc, base, end, s, e, first_doc, first_start, last_doc, last_start, before, behind in zip(docs_[first_text + text[right]].tolist(), begins[right].tolist(), ends[right].tolist(), *of_run):
                    # Within one text the first occurrence stays whole.
                    room = min(CONTEXT, s, s - first_start - SEED) if first_doc == doc else min(CONTEXT, s)
                    back, left = low[base + s - room : base + s][::-1].tolist(), np.frombuffer(before, "<u4")[::-1].tolist()
                    on, next_ = low[base + e : min(base + e + CONTEXT, end)].tolist(), np.frombuffer(behind, "<u4").tolist()
                    if e - s + _agreeing(back, left, 0, 0) + _agreeing(on, next_, 0, 0) < min(least, SEED + AROUND):
                        continue  # another stretch of its passage, if there is one, is longer
                    x, y = widest(e - s, reach(back, left, shingle), reach(on, next_, shingle), threshold, shingle)
                    begin, to = s - x[0], e + y[0]
                    if to - begin < least:
                        continue
                    ref = first_doc, first_start - x[1]
                    out.append((doc, begin, span_hash(hashes, base + begin, base + to), *ref, False, to - begin))
                    if first_doc == last_doc and last_start + SEED - first_start == e - s:
                        out.append((*ref, 0, *ref, True, e - s + x[1] + y[1]))
                    else:
                        out.append((*ref, 0, *ref, True, x[1] + SEED))
                        out.append((last_doc, last_start, 0, last_doc, last_start, True, SEED + y[1]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "paragraph", "ref_doc", "ref_start", "kept", "words"])

    of_text = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "low", "high", "left", "right")).alias("w"))
    rows = of_text.hint("shuffle_hash").join(_texts(docs), "doc_id").select("doc_id", "text", "w")
    return rows.mapInArrow(tidied(extend), "doc_id bigint, start int, paragraph bigint, ref_doc bigint, ref_start int, kept boolean, words int").distinct()


def widest(n: int, before: list[tuple[int, int, int]], behind: list[tuple[int, int, int]], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """The ends of the widest passage around a run of n words whose similarity, over its places, reaches the threshold."""
    best = before[0], behind[0]
    for x in before:
        for y in behind:
            both = n - shingle + 1 + x[2] + y[2]
            either = 2 * (n - shingle + 1) + x[0] + x[1] + y[0] + y[1] - both
            if both >= threshold * either - 1e-9 and x[0] + y[0] > best[0][0] + best[1][0]:
                best = x, y
    return best


def span_hash(hashes: np.ndarray, begin: int, end: int) -> int:
    return _key(hashes[begin:end].tobytes())


def passages(docs: DataFrame, threshold: float = THRESHOLD, least: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, start, paragraph, ref_doc, ref_start, kept, words) of whole passages of at least so many words that occur again."""
    found = written(recurring(seeds(docs, least, shingle), "seed"), "seeds")  # seeds that occur once are not written
    parts = [written(repeated_seeds(found.filter(F.pmod("seed", F.lit(SEED_PARTS)) == k)), "repeated-seeds") for k in range(SEED_PARTS)]
    discard(found)
    again = written(runs(reduce(DataFrame.unionByName, parts)), "runs")
    discard(*parts)
    wanted = again.select("low.*", F.lit(True).alias("before")).unionByName(again.select("high.*", F.lit(False).alias("before"))).distinct()
    around = written(contexts(docs, wanted), "contexts")

    def beside(end: str, before: bool, side: str) -> DataFrame:
        return around.filter(F.col("before") == before).select(F.struct("r_doc", "r_start", "seed").alias(end), F.col("beside").alias(side))

    rows = again.join(beside("low", True, "left"), "low").join(beside("high", False, "right"), "high")
    out = written(extended(docs, rows, least, threshold, shingle), "passages-found")
    discard(again, around)
    return out


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, step: int = STEP, shingle: int = SHINGLE, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, paragraph, ref_doc, ref_start, kept, words) of every paragraph that occurs again, equal or similar, and of
    the whole passages; paragraph is a hash of the words of the place, ref_doc and ref_start the place of the first occurrence.
    doc_id and ref_doc are the names of rows (ids, if each row has its own), by which spans() and remove() know them."""
    shared = _shared_ids(docs)
    docs = _named(docs.select("doc_id", "text"), shared).select(F.col("__row").alias("doc_id"), "text")
    docs = docs if shared is None else docs.dropDuplicates(["doc_id"])
    parts = Paragraphs(size, step, shingle, bands_for(threshold))
    found = written(occurrences(docs, parts), "paragraphs")
    distinct = written(distinct_paragraphs(found, size), "distinct")
    by_band = collisions(distinct, size)
    pairs = reduce(DataFrame.unionByName, by_band)
    wanted = distinct.join(pairs.select("paragraph").distinct(), "paragraph", "left_semi").select("paragraph", "doc_id")
    lists = written(shingle_lists(docs, wanted, parts), "shingle-lists")
    edges = near_edges(pairs, lists, threshold, large, block)
    discard(*by_band, lists)
    labels = written(components(edges), "labels")
    out = repeated(found, distinct, labels, size)
    discard(edges, labels, distinct, found)
    return out.unionByName(passages(docs, threshold, size, shingle))


def spans(found: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Runs of words that the duplicates of docs cover: doc_id, start_word, end_word (behind the last), kept,
    passage, passages and paragraphs. Kept and removed runs are apart; a run of several passages has the least as passage. Of rows of
    one id and one text all but one are removals whole.

    A passage is a run of kept places of one text; what is removed is named by the run that holds its first occurrence, so all
    texts that repeat a passage, or parts of it, name it alike; and where kept places overlap removed ones, as a passage of one
    text is part of another's, the two are one (components). Kept places inside removed passages are not listed."""
    end = F.col("start") + F.col("words")

    def numbered(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc_id").orderBy("start", F.desc("words"))
        past = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("new", F.coalesce(F.col("start") > F.max(end).over(past), F.lit(True)).cast("int"))
        return rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    kept = numbered(found.filter("kept").select("doc_id", "start", "words").distinct())
    kept = kept.withColumn("passage", F.xxhash64("doc_id", F.min("start").over(Window.partitionBy("doc_id", "run"))))
    named = kept.groupBy(F.col("doc_id").alias("ref_doc"), F.col("start").alias("ref_start")).agg(F.min("passage").alias("passage"))
    removed = found.filter("not kept").select("doc_id", "start", "words", "ref_doc", "ref_start").distinct()
    removed = removed.join(named, ["ref_doc", "ref_start"]).select("doc_id", "start", "words", "passage", F.lit(False).alias("kept"))
    # What lies in a removed passage is no kept place, though it is the first of its own words.
    both = written(kept.select("doc_id", "start", "words", "passage", F.lit(True).alias("kept")).unionByName(removed), "span-parts")
    before = Window.partitionBy("doc_id").orderBy("start", "kept", F.desc("words"), "passage").rowsBetween(Window.unboundedPreceding, -1)
    other = F.struct(end.alias("end"), "passage")
    other = F.when(F.col("kept"), F.max(F.when(~F.col("kept"), other)).over(before)).otherwise(F.max(F.when(F.col("kept"), other)).over(before))
    alike = both.withColumn("other", other).filter((F.col("other.end") > F.col("start")) & (F.col("other.passage") != F.col("passage")))
    alike = written(alike.select(F.col("passage").alias("a"), F.col("other.passage").alias("b")).distinct(), "alike")
    names = written(components(alike), "passage-names").withColumnRenamed("vertex", "passage")
    both = both.join(names, "passage", "left").withColumn("passage", F.coalesce("component", "passage")).drop("component")
    gone = F.max(F.when(~F.col("kept"), end)).over(Window.partitionBy("doc_id").orderBy("start"))
    both = both.withColumn("gone", gone).filter(~F.col("kept") | F.coalesce(F.col("gone") < end, F.lit(True)))
    order = Window.partitionBy("doc_id", "kept").orderBy("start", F.desc("words"), "passage")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("new", F.coalesce(F.col("start") > F.max(end).over(past), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Plain numbers first: the lists are made of a run's different passages.
    of = rows.groupBy("doc_id", "kept", "run", "passage").agg(F.min("start").alias("start_word"), F.max(end).alias("end_word"), F.count("*").alias("n"))
    out = of.groupBy("doc_id", "kept", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("passage").alias("passage"), F.array_sort(F.collect_list("passage")).alias("passages"), F.sum("n").alias("paragraphs"))
    out = out.select("doc_id", "start_word", "end_word", "kept", "passage", "passages", "paragraphs")
    shared = _shared_ids(docs)
    if shared is None:
        return out
    rows = _named(docs.select("doc_id", "text"), shared).filter(F.col("__row") >= NO_IDS)
    rows = written(rows.groupBy("__row").agg(F.max("doc_id").alias("id"), F.count("*").alias("n"), F.max(_count_of_words(F.col("text"))).alias("n_words")), "named-rows")
    real = F.when(F.col("__row").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    out = out.join(rows.select("__row", "id"), F.col("doc_id") == F.col("__row"), "left").withColumn("doc_id", real).drop("__row", "id")
    again = rows.filter((F.col("n") > 1) & (F.col("n_words") >= size)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    passage = F.xxhash64(F.lit("copies"), F.col("__row"))
    again = again.select(F.col("id").alias("doc_id"), F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), (F.col("copy") == 1).alias("kept"), passage.alias("passage"), F.array(passage).alias("passages"), F.lit(1).cast("bigint").alias("paragraphs"))
    return out.unionByName(again)


def _count_of_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def remove(docs: DataFrame, found: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without the removals of duplicates(): their words are cut from the texts, and documents of
    which nothing is left are dropped. The columns of docs."""
    names_of = list(docs.columns)
    at, n = names_of.index("text"), len(names_of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, starts, names, lengths in zip(batch.column(at), *(batch.column(n + k).to_pylist() for k in range(3))):
                whole = text.as_py()
                if starts and whole:
                    whole = without(whole, starts, names, size, lengths)
                texts.append(whole)
                keep.append(whole != "" or not starts)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays(columns, names=names_of).filter(pa.array(keep, pa.bool_()))

    gone = found.filter("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("start", "paragraph", "words")).alias("w"))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("w.start").alias("__starts"), F.col("w.paragraph").alias("__paragraphs"), F.col("w.words").alias("__words"))
    shared = _shared_ids(docs)
    rows = _named(docs, shared)
    if shared is not None:
        copies = (F.col("__row") >= NO_IDS) & (_count_of_words(F.col("text")) >= size)
        one = rows.filter(copies).groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*", "__row")
        rows = one.unionByName(rows.filter(~copies))
    rows = rows.join(gone, F.col("__row") == F.col("__gone"), "left").drop("__gone", "__row")
    return rows.mapInArrow(tidied(cut), docs.schema)


def without(text: str, starts: list[int], paragraphs: list[int], size: int, lengths: list[int] | None = None) -> str:
    """A text without the paragraphs and passages that it holds at these places; lengths are in words, size for all if absent."""
    data = text.encode("utf-8")
    begin, _, hashes = words(data)
    if len(hashes) < size:
        return text
    whole = windows_at(hashes, np.clip(np.array(starts), 0, len(hashes) - size), size).view(np.int64).tolist()
    gone = np.zeros(len(begin) + 1, np.int64)
    for s, here, p, n in zip(starts, whole, paragraphs, lengths or [size] * len(starts)):
        if s + n <= len(hashes) and (n == size and here == p or span_hash(hashes, s, s + n) == p):
            gone[s] += 1
            gone[s + n] -= 1
    drop = np.cumsum(gone[:-1]) > 0
    if not drop.any():
        return text
    ends = np.append(begin[1:], len(data))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], drop, [True]))))
    out = [data[: begin[0]]] if len(edges) and edges[0] == 0 else []
    for a, b in zip(edges[0::2], edges[1::2]):
        out.append(data[begin[a] : ends[b - 1]])
    return b"".join(out).decode("utf-8").strip()
