"""Source divergence audit: how far the term use of each source lies from that of the other sources of its language.

A term is a run of letters of ASCII and of any bytes beyond it, A-Z in lower case. A numpy lookup table over the
concatenated UTF-8 buffers of a batch finds the terms' bounds; slices are grouped by xxhash and every slice is then compared
with the first of its group byte by byte (slices that differ are grouped by their bytes). What leaves a task is a row for
each language, source and term of a chunk of text.

A language keeps the terms of at least `least` of its documents: V terms. A group (language, source) or a language gives a
kept term that it holds n times the share p = 1 + floor(10**9 * (n + 1) / (N + V)), N being the count of all kept terms
there. The divergence of p from q is floor((p - q)**2 / q). All arithmetic is that of whole numbers.

Part `pair`: for each ordered pair of sources of a language the sum over all kept terms. The kept terms of a language are
dealt out in buckets, its sources in blocks, and a cell is a bucket with two blocks. In a cell the counts are a sparse matrix
by columns; a source's shares are laid out over the bucket's terms and its differences from all other columns are summed by
reduceat. Terms that neither source holds have one share each and are counted, not visited.
Part `term`: the terms that a source uses more than its language does, the `top` of greatest divergence.

Defined cases: null text, lang and source are empty strings; a group without terms gets its pairs like any other (0 where
the language keeps no term); a source alone in its language has no pairs; repeated rows count each; order is by value, then by
the bytes of the item; texts of any length are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, written
from brindle.llm.groups import grouped, in_cells, tidied

LEAST_DOCUMENTS, TOP = 3, 200
SCALE = 10**9
CHUNK = 8 << 20  # bytes of text looked at together
BUCKET, BLOCK = 100_000, 256  # counts in a bucket of terms, sources in a block
LONG = 256  # slices over this many bytes are compared one by one

# The byte that a term's byte counts as; 0 parts terms.
LOWER = np.zeros(256, np.uint8)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, starts, ends) of the terms of texts that lie one after the other in data."""
    lowered = LOWER[data]
    inside = lowered != 0
    first = np.ones(len(data) + 1, bool)  # a term can't go on from before this place
    first[1:-1] = ~inside[:-1]
    first[offsets] = True
    return lowered, np.flatnonzero(inside & first[:-1]), np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1


def _equal(words: np.ndarray, lowered: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the slices of these lengths at a and at b have equal bytes. words: the eight bytes from each place on."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = np.array_equal(lowered[a[i] : a[i] + lengths[i]], lowered[b[i] : b[i] + lengths[i]])
    here = np.flatnonzero((lengths <= LONG) & (a != b))
    at = 0
    while len(here):
        left = lengths[here] - at
        differ = words[a[here] + at] ^ words[b[here] + at]
        differ &= np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        out[here[differ != 0]] = False
        here = here[(left > 8) & (differ == 0)]
        at += 8
    return out


def grouped_slices(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(number of each slice's term, a slice of each term): slices of one term have equal bytes."""
    text = lowered.tobytes()
    hashes = np.fromiter((digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    words = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    lengths, leader = ends - starts, first[code]
    same = lengths == lengths[leader]
    same[same] = _equal(words, lowered, starts[same], starts[leader[same]], lengths[same])
    others: dict[bytes, int] = {}
    more: list[int] = []
    for i in np.flatnonzero(~same).tolist():
        key = text[starts[i] : ends[i]]
        if key not in others:
            others[key] = len(first) + len(more)
            more.append(i)
        code[i] = others[key]
    return code, np.concatenate([first, np.array(more, first.dtype)])


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts, a row for each term of a chunk, and one with an empty term for each group."""
    kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            seen: dict[tuple[str, str], int] = {}
            group = np.array([seen.setdefault(x, len(seen)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            names = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names]), pa.array([x[1] for x in names]), pa.array([b""] * len(names)), pa.array([0] * len(names)), pa.array([0] * len(names))], schema=pa.schema(kinds))
            for a, b in _chunks(offsets):
                within = offsets[a : b + 1] - offsets[a]
                lowered, starts, ends = term_bounds(data[offsets[a] : offsets[b]], within)
                if not len(starts):
                    continue
                code, slices = grouped_slices(lowered, starts, ends)
                row = np.searchsorted(within, starts, "right") - 1
                total = len(slices)
                key, n = np.unique(group[a:b][row] * total + code, return_counts=True)
                pairs = np.unique(row * total + code)
                held, documents = np.unique(group[a:b][pairs // total] * total + pairs % total, return_counts=True)
                bytes_of = lowered.tobytes()
                terms = pa.array([bytes_of[starts[i] : ends[i]] for i in slices.tolist()], pa.binary())
                of_group = key // total
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in names]).take(pa.array(of_group)), pa.array([x[1] for x in names]).take(pa.array(of_group)), terms.take(pa.array(key % total)), pa.array(n), pa.array(documents[np.searchsorted(held, key)])],
                    schema=pa.schema(kinds),
                )

    empty = F.lit("")
    read = docs.select(F.coalesce(F.col("lang").cast("string"), empty), F.coalesce(F.col("source").cast("string"), empty), F.coalesce(F.col("text"), empty).cast("binary"))
    return read.mapInArrow(tidied(count), "lang string, source string, term binary, n bigint, docs bigint")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), by long division in thousands, so that no product leaves 64 bits."""
    left, whole, by = n + 1, F.lit(0).cast("bigint"), total + terms
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + F.floor(_div(left, by))
        left = left % by
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _pair_sums(entries: DataFrame, groups: DataFrame, bucket: int, block: int) -> DataFrame:
    """(a, b, value, held): sums over the terms that one of two groups holds, and the number of those terms.
    entries: gid, lang, term, p. groups: gid, lang, p0, n_sources, n_entries."""
    sizes = groups.select("gid", "lang", "p0", F.ceil(F.col("n_sources") / block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("n_entries") / bucket)).cast("int").alias("buckets"))
    sizes = sizes.withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    rows = entries.select("gid", "term", "p").join(sizes.drop("p0"), "gid").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    columns = ["lang", "bucket", "gid", "term", "p", "block", "blocks"]
    # Every group of a block stands in all of the block's cells, with the share of a term that it does not hold.
    marks = sizes.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).select("lang", "bucket", "gid", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), "block", "blocks")
    rows = rows.select(*columns).unionByName(marks)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("lang", "bucket", F.least("block", "other"), F.greatest("block", "other"))).select("cell", "gid", "term", "p", "block", "other")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            yield from _cell_sums(group)

    return in_cells(rows, sums, "a bigint, b bigint, value bigint, held bigint").groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))


def _cell_sums(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sums of one cell: a source's shares over the bucket's terms against the columns of all others."""
    term = cell.column(2).combine_chunks()
    gid, p, block = (cell.column(k).to_numpy() for k in (1, 3, 4))
    mark = term.is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(gid[mark], kind="stable")
    sources, base, block_of = gid[mark][order], p[mark][order], block[mark][order]
    code = term.filter(pa.array(~mark)).dictionary_encode()
    number, n_terms = code.indices.to_numpy(), len(code.dictionary)
    column = np.searchsorted(sources, gid[~mark])
    order = np.argsort(column, kind="stable")
    number, column, q = number[order], column[order], p[~mark][order]
    held = np.bincount(column, minlength=len(sources))
    start = np.concatenate([[0], np.cumsum(held)])
    full = np.flatnonzero(held)
    apart = cell.column(4)[0].as_py() != cell.column(5)[0].as_py()  # pairs within a block meet in its own cell, even if the other is empty

    def by_column(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sources), np.int64)
        if len(full):
            out[full] = np.add.reduceat(values, start[full])
        return out

    for a in range(len(sources)):
        own = slice(start[a], start[a + 1])
        shares, has = np.full(n_terms, base[a]), np.zeros(n_terms, bool)
        shares[number[own]], has[number[own]] = q[own], True
        x, both = shares[number], has[number]
        there = by_column((x - q) ** 2 // q)
        q0 = base[column]
        twice = by_column(np.where(both, (x - q0) ** 2 // q0, 0))
        alone = np.array([((q[own] - s) ** 2 // s).sum() for s in base], np.int64)
        shared = by_column(both.astype(np.int64))
        wanted = (block_of != block_of[a]) if apart else np.arange(len(sources)) != a
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(wanted.sum(), sources[a])), pa.array(sources[wanted]), pa.array((there + alone - twice)[wanted]), pa.array((held[a] + held - shared)[wanted])], names=["a", "b", "value", "held"]
        )


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts. docs: text, lang, source."""
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    entries = counts.filter(F.octet_length("term") > 0).withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    entries = entries.withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("bigint"))
    entries = written(entries.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms")

    found = counts.select("lang", "source").distinct().join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"), F.sum("first").alias("first")), ["lang", "source"], "left")
    zero = F.lit(0).cast("bigint")
    found = found.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "first")])
    of_lang = found.groupBy("lang").agg(F.sum("first").alias("vocabulary"), F.sum("total").alias("lang_total"), F.sum("n_terms").alias("n_entries"), F.count("*").alias("n_sources"))
    groups = found.drop("first", "n_terms").join(of_lang, "lang").withColumn("gid", F.monotonically_increasing_id())
    groups = groups.withColumn("p0", F.when(F.col("vocabulary") > 0, share(zero, F.col("total"), F.greatest("vocabulary", F.lit(1)))))
    groups = written(groups, "divergence-groups")

    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    shares = entries.join(groups.select("lang", "source", "gid", "total", "lang_total", "vocabulary"), ["lang", "source"])
    shares = shares.select("lang", "source", "gid", "term", p.alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    sums = _pair_sums(shares.select("gid", "lang", "term", "p"), groups.filter("vocabulary > 0"), bucket, block)
    one = groups.select("lang", "source", F.col("gid").alias("a"), F.col("p0").alias("pa"), "vocabulary")
    two = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("pb"))
    pairs = one.join(two, "lang").filter("a <> b").join(sums, ["a", "b"], "left")
    rest = F.when(F.col("vocabulary") > 0, divergence(F.col("pa"), F.col("pb")) * (F.col("vocabulary") - F.coalesce("held", zero)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", zero) + F.coalesce(rest, zero)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    out = written(pairs.unionByName(terms), "divergences")
    discard(counts, entries, groups)
    return out
