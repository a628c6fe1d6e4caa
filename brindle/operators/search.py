"""Retrieval: dense, sparse and full-text ranking, fusion, expansion, merging and near-duplicate removal.

Every function takes a table of queries, so one plan serves a batch of questions. Order is always
completed by keys, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.session import stored, stored_bytes

BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 8 << 20


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """True if df has few rows and few bytes; no more than the bound of rows is looked at."""
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return size["n"] <= most and size["b"] <= most_bytes


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES, part_of: DataFrame | None = None) -> DataFrame:
    """df marked for broadcast if it is small; else for a join that sends neither side to all tasks, as Spark takes packed files and
    exploded rows to be much smaller than they are. A stored table (or df as a part of one) is small if an eighth of the bytes holds
    its files, as they are packed, and, as repeated values pack to almost nothing, df has few enough bytes and ten times the rows at most;
    of any other table rows and bytes are counted."""
    size = stored_bytes(df if part_of is None else part_of)
    if size is None:
        fits = is_small(df, most, most_bytes)
    else:
        fits = size <= most_bytes // 512 or size <= most_bytes // 8 and is_small(df, 10 * most, most_bytes)
    return F.broadcast(df) if fits else df.hint("merge")


def in_blocks(queries: DataFrame, search, query: str = "query_id", most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """search(block) over blocks of the queries that are small enough to be sent to all tasks; a stated set of queries is
    one block as a rule. The blocks part the queries by a hash of their ids."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    n = max(1, -(-2 * size["n"] // most) if size["n"] > most else 1, -(-2 * size["b"] // most_bytes) if size["b"] > most_bytes else 1)
    parts = [queries if n == 1 else queries.filter(F.pmod(F.xxhash64(query), F.lit(n)) == k) for k in range(n)]
    out = None
    for part in parts:
        found = search(F.broadcast(part))
        out = found if out is None else out.unionByName(found)
    return out


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def ranked(df: DataFrame, query: str, *order: Column, into: str = "rank0") -> DataFrame:
    """df with the place of each row of a query, from 0."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1).cast("bigint"))


def top_k(df: DataFrame, query: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query with rank0; Spark limits each task's groups before the shuffle."""
    return ranked(df, query, *order).filter(F.col("rank0") < k)


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query_id", item: str = "item_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """(query, item, score, rank0): the k nearest items by dot product of unit vectors; only scores above least, if given.

    Queries are a stated set: they go to all tasks in blocks of a checked size. A batch of items is scored against a block by one product of
    matrices, and only the first k of each query leave it (with those that tie with the last), so n items never become n rows
    for each query. Scores are rounded to 12 places, as the order of a sum may differ in the last one. Items and queries without a
    vector, or with a null in it, are left out; an item is compared with the queries of its size."""
    kind = to_arrow_type(queries.schema[query].dataType)
    names = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{item}` {corpus.schema[item].dataType.simpleString()}, score double"
    whole = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull())
    items = corpus.filter(whole(F.col(vector))).select(item, F.col(vector).cast("array<double>").alias("v"))

    def block(q: DataFrame) -> DataFrame:
        rows = q.filter("qv is not null").collect()  # bounded by in_blocks
        sizes = {len(r[1]) for r in rows}
        sent = q.sparkSession.sparkContext.broadcast({n: ([r[0] for r in rows if len(r[1]) == n], np.array([r[1] for r in rows if len(r[1]) == n], float)) for n in sizes})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                lengths = np.diff(whole_batch.column(1).offsets.to_numpy())
                for n in set(lengths.tolist()) & set(sent.value):
                    yield from of_size(whole_batch if (lengths == n).all() else whole_batch.filter(pa.array(lengths == n)), *sent.value[n])

        def of_size(batch: pa.RecordBatch, ids: list, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids = pa.array(ids, kind)
            if batch.num_rows and len(ids):
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                scores = np.round(x @ matrix.T, 12)
                bound = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else scores.min(axis=0)
                kept = scores >= bound
                if least is not None:
                    kept &= scores > least
                i, j = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), batch.column(0).take(pa.array(i)), pa.array(scores[i, j])], names=[query, item, "score"])

        return top_k(items.mapInArrow(score, names), query, k, F.desc("score"), F.asc(item))

    return in_blocks(queries.filter(whole(F.col(vector))).select(query, F.col(vector).alias("qv")), block, query)


def terms(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length): the inverted index of a table of texts; with `only` (term), a small table, of those terms alone, and then
    no other term is shuffled."""
    d = docs.select(key, terms(F.col(text)).alias("t"))
    d = d.select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    if only is not None:
        d = d.join(small(only.select("term").distinct()), "term", "left_semi")
    return d.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(query, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def sparse_search(queries: DataFrame, index: DataFrame, n_docs: int, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score, rank0): the k best by the sum over common terms of idf * (1 + ln tf), idf = ln(1 + n / df). The part of
    the index that holds the queries' terms is stored, as it is read twice."""
    wanted = query_terms(queries, query)
    used = stored(index.join(small(wanted.select("term").distinct()), "term", "left_semi").select("term", key, "tf"))
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    weighted = used.join(small(df), "term").select("term", key, ((1 + F.log("tf")) * F.log1p(F.lit(float(n_docs)) / F.col("df"))).alias("w"))
    scores = weighted.join(small(wanted), "term").groupBy(query, key).agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scores, query, k, F.desc("score"), F.asc(key))


# Tokens of a model that carry no meaning, and the entry of a text without any other.
SPECIAL_TOKENS, NO_TOKEN, NO_WEIGHT = (0, 1, 2), 1, 0.01


def sparse_vectors(tokens: DataFrame, key: str = "key", token: str = "token", weight: str = "weight") -> DataFrame:
    """(key, token, weight): the greatest weight of each token of a text, of those above zero; a text without such tokens gets
    one entry, so that it has a vector. tokens has a row for each place of a text."""
    real = (F.col(weight) > 0) & ~F.col(token).isin(*SPECIAL_TOKENS)
    g = tokens.groupBy(key, F.when(real, F.col(token)).alias("t")).agg(F.max(F.when(real, F.col(weight))).alias("w"))
    with_any = g.filter("t is not null")
    alone = g.groupBy(key).agg(F.count("t").alias("n")).filter("n = 0")
    none = alone.select(key, F.lit(NO_TOKEN).cast(tokens.schema[token].dataType).alias("t"), F.lit(NO_WEIGHT).alias("w"))
    return with_any.select(key, "t", "w").unionByName(none).select(key, F.col("t").alias(token), F.col("w").cast("double").alias(weight))


DENSE_TOKENS, SCORES_AT_ONCE = 1024, 1 << 21


def sparse_dot(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "key", token: str = "token", weight: str = "weight") -> DataFrame:
    """(query, key, score, rank0): the k best by the dot product of sparse vectors, rows of (query or key, token, weight).

    Queries are a stated set, sent to all tasks in blocks of checked size. The entries of a key come together, and keys are scored against a
    block as products of matrices (of its first DENSE_TOKENS different tokens; entries of others one by one); only rows that may be among the first k of
    a query leave a task, so keys never become rows for each query. Keys that share no token with a query are not found; entries
    without a token or a weight do not count."""
    kind, found = to_arrow_type(queries.schema[query].dataType), to_arrow_type(vectors.schema[token].dataType)
    names = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"

    def entries(of: DataFrame, by: str) -> DataFrame:
        d = of.select(F.col(by), F.col(token).alias("t"), F.col(weight).cast("double").alias("w")).dropna(subset=["t", "w"])
        return d.groupBy(by).agg(F.collect_list(F.struct("t", "w")).alias("e")).select(by, F.col("e.t").alias("t"), F.col("e.w").alias("w"))

    items = stored(entries(vectors, key))

    def block(q: DataFrame) -> DataFrame:
        rows = q.collect()  # bounded by in_blocks
        known = pa.array([t for r in rows for t in r["t"]], found).unique()
        at = np.array(pc.index_in(pa.array([t for r in rows for t in r["t"]], found), known), np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r["t"]) for r in rows])
        sent = q.sparkSession.sparkContext.broadcast(([r[0] for r in rows], known, at, of, np.array([w for r in rows for w in r["w"]], float)))
        return top_k(items.mapInArrow(lambda batches: _best_products(batches, sent.value, kind, k, [query, key, "score"]), names).withColumn("score", F.round("score", 6)), query, k, F.desc("score"), F.asc(key))

    return in_blocks(entries(queries, query), block, query)


def _best_products(batches: Iterator[pa.RecordBatch], block: tuple, kind: pa.DataType, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query, key, score) of the pairs of a task's keys and a block's queries that may be among the first k of a query, ties included."""
    ids, known, at, of, weights = block
    if not len(ids):
        return
    ids, wide = pa.array(ids, kind), min(len(known), DENSE_TOKENS)
    dense, there = np.zeros((wide, len(ids))), np.zeros((wide, len(ids)), np.float32)
    np.add.at(dense, (at[at < wide], of[at < wide]), weights[at < wide])
    there[at[at < wide], of[at < wide]] = 1
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(known) + 1))
    positive = bool((weights > 0).all())
    best = np.full((k, len(ids)), -np.inf)  # of the keys seen so far
    step = max(1, SCORES_AT_ONCE // max(len(ids), wide))
    for batch in batches:
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            tokens, values = part.column(1), part.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), np.array(pc.list_value_length(tokens)))
            place = np.array(pc.fill_null(pc.index_in(tokens.flatten(), known), -1), np.int64)
            near, far = (place >= 0) & (place < wide), np.flatnonzero(place >= wide)
            x = np.zeros((part.num_rows, wide))
            np.add.at(x, (row[near], place[near]), values[near])
            scores = x @ dense
            for i in far.tolist():
                asked = order[starts[place[i]] : starts[place[i] + 1]]
                np.add.at(scores[row[i]], of[asked], values[i] * weights[asked])
            if positive and (values > 0).all():
                met = scores > 0
            else:
                x[:] = 0
                x[row[near], place[near]] = 1
                met = x.astype(np.float32) @ there > 0
                for i in far.tolist():
                    met[row[i], of[order[starts[place[i]] : starts[place[i] + 1]]]] = True
            scores[~met] = -np.inf
            both = np.concatenate([best, scores])
            best = np.partition(both, -k, axis=0)[-k:]
            i, j = np.nonzero(met & (scores >= best.min(axis=0) - 2e-6))  # scores are rounded to six places afterwards
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(scores[i, j])], names=names)


def sanitised(query: Column) -> Column:
    """A full-text query without operators and wildcard marks; null if nothing is left."""
    q = F.regexp_replace(query, r"(?i)\b(AND|OR|NOT|NEAR)\b", " ")
    q = F.trim(F.regexp_replace(F.regexp_replace(q, r"[*^\"'()]", " "), r"\s+", " "))
    return F.when(q != "", q)


def phrase_search(queries: DataFrame, docs: DataFrame, query: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key): documents that hold the whole query as one phrase of terms. A document meets only the phrases whose
    longest term it holds, and those are then looked for in it."""
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    q = queries.select(query, terms(sanitised(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    anchor = F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    q = q.select(query, spaced(F.col("t")).alias("phrase"), anchor.alias("anchor"))
    d = docs.select(key, terms(F.col(text)).alias("t"))

    def block(some: DataFrame) -> DataFrame:
        anchors = some.agg(F.collect_set("anchor").alias("anchors"))  # one row, of a block's terms
        met = d.crossJoin(F.broadcast(anchors)).select(key, spaced(F.col("t")).alias("body"), F.explode(F.array_intersect("t", "anchors")).alias("anchor"))
        return met.join(some, "anchor").filter(F.col("body").contains(F.col("phrase"))).select(query, key)

    return in_blocks(q, block, query)


def contains_search(queries: DataFrame, docs: DataFrame, query: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key): the fallback, documents that hold the query as it stands. Each text is searched once for each query of
    a stated set, in blocks."""
    q = queries.select(query, F.col("text").alias("needle")).filter("needle <> ''")
    d = docs.select(key, F.col(text).alias("body"))
    return in_blocks(q, lambda some: d.join(some, F.col("body").contains(F.col("needle"))).select(query, key), query)


def fused(lists: list[DataFrame], query: str, keys: list[str], k: int = 61) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank0) over the lists, in which rows without a key do not count."""
    rows = None
    for one in lists:
        one = one.select(query, *keys, "rank0").dropna(subset=keys)
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(query, *keys).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank0"))), 9).alias("score"))


def expanded(hits: DataFrame, chunks: DataFrame, width: int = 1, query: str = "query_id", key: str = "doc_id", decay: float = 0.9) -> DataFrame:
    """Hits and their neighbours within a distance in the same document; a neighbour has its best parent's score times
    the decay. The band join is an equality join on the exploded places."""
    near = hits.withColumn("at", F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)))
    near = near.select(query, key, F.col("at").alias("chunk_index"), F.when(F.col("at") == F.col("chunk_index"), F.col("score")).otherwise(F.col("score") * decay).alias("score"))
    best = near.groupBy(query, key, "chunk_index").agg(F.max("score").alias("score"))
    return best.join(chunks.select(key, "chunk_index", "document"), [key, "chunk_index"])


def merged(hits: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Neighbouring chunks joined to one: runs of indices with steps of one, texts joined by blank lines, the highest score."""
    order = Window.partitionBy(query, key).orderBy("chunk_index")
    before = F.lag("chunk_index").over(order)
    starts = F.coalesce((F.col("chunk_index") - before > 1) | (F.col("chunk_index") < 0) | (before < 0), F.lit(True))
    runs = hits.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "document")))
    return runs.groupBy(query, key, "run").agg(
        F.min("chunk_index").alias("chunk_index"),
        F.count("*").alias("n_chunks"),
        F.max("score").alias("score"),
        F.array_join(F.transform(parts, lambda p: p["document"]), "\n\n").alias("document"),
    ).drop("run")


def grams(text: Column, n: int = 3) -> Column:
    """Different n-grams of the characters that are not white space; a shorter text is its own only one."""
    squeezed = F.array(F.regexp_replace(text, r"\s+", ""))  # a list of one binds the value, which is computed once
    cut = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n))))
    return F.element_at(F.transform(squeezed, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(cut(t))), 1)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different elements."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def accepted(hits: DataFrame, most: int, query: str = "query_id", text: str = "document", limit: float = 0.6) -> DataFrame:
    """Hits of a query in order of score, each taken only if it is not too like one taken before, until there are enough.
    Order matters, so the fold runs over the bounded list of a query's hits."""
    g = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "chunk_index", text, grams(F.col(text)).alias("g")))).alias("h"))
    kind = g.schema["h"].dataType.simpleString()
    fold = F.aggregate(
        "h",
        F.array().cast(kind),
        lambda acc, h: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: overlap(a["g"], h["g"]) > limit), acc).otherwise(F.concat(acc, F.array(h))),
    )
    rows = g.select(query, F.posexplode(fold).alias("rank0", "h"))
    return rows.select(query, F.col("rank0").cast("bigint").alias("rank0"), "h.doc_id", "h.chunk_index", (-F.col("h.s")).alias("score"), F.col(f"h.{text}").alias(text))


def boosted_first(hits: DataFrame, hit: Column, query: str = "query_id") -> DataFrame:
    """Hits that satisfy a condition before the others, both in their order."""
    return ranked(hits.withColumn("boosted", F.coalesce(hit, F.lit(False))), query, F.desc("boosted"), F.asc("rank0"), into="place")


def snippet(text: Column, most: int = 150, head: int = 80, data: int = 70) -> Column:
    """A short text whole; of a long one the head of its first line and the first later line with a digit."""
    lines = F.split(text, "\n")
    later = F.get(F.filter(F.slice(lines, 2, 1 << 30), lambda x: x.rlike(r"\d")), F.lit(0))
    two = F.concat(F.get(lines, F.lit(0)).substr(1, head), F.lit(" ... "), later.substr(1, data))
    short = F.when(F.length(text) <= most, text).otherwise(F.coalesce(two, text.substr(1, most)))
    return F.coalesce(F.nullif(F.trim(F.replace(short, F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("(空)"))


def reranked(hits: DataFrame, order: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Hits in the order a ranker gave (query, rank0, place); its repeats and unknown places do not count. Rows that it left
    out follow with score 0; others score 1 - place / n. Queries of at most two hits stay as they are."""
    first = order.groupBy(query, "rank0").agg(F.min("place").alias("place"))
    n = Window.partitionBy(query)
    d = hits.join(first, [query, "rank0"], "left").withColumn("n", F.count("*").over(n)).withColumn("listed", F.count("place").over(n))
    d = ranked(d, query, F.when(F.col("n") <= 2, F.col("rank0")).otherwise(F.coalesce("place", F.lit(1 << 40))), F.asc("rank0"), into="new")
    score = F.when(F.col("n") <= 2, F.col("score")).when(F.col("place").isNull(), F.lit(0.0)).otherwise(1 - F.col("new") / F.col("listed"))
    return d.filter((F.col("new") < k) | (F.col("n") <= 2)).withColumn("score", score).withColumn("rank0", F.col("new")).drop("n", "listed", "place", "new")


def lexical_order(hits: DataFrame, queries: DataFrame, query: str = "query_id", text: str = "document") -> DataFrame:
    """The default ranker: by the share of the query's terms that a hit holds."""
    d = hits.join(queries.select(query, F.array_distinct(terms(F.col("text"))).alias("qt")), query)
    share = F.size(F.array_intersect(F.col("qt"), terms(F.col(text)))) / F.greatest(F.size("qt"), F.lit(1))
    return ranked(d.withColumn("share", share), query, F.desc("share"), F.asc("rank0"), into="place").select(query, "rank0", "place")


def prefiltered(summaries: DataFrame, files: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The files to search: the best by their summary's rank, more of them where there are many files."""
    return summaries.filter(F.col("rank0") < (12 if files > 50 else 8)).select(query, key)


def pool_size(k: int, files: int) -> int:
    """Rows to fetch before fusion."""
    return max(k * (4 if files <= 5 else 6 if files > 50 else 5), 30)


# Spellings of questions put right, the files beyond which summaries are searched first, the rows that a
# ranker sees, the inner constant of fusion, words of parameters, and words of questions that ask for figures.
TYPOS = {"地型": "地形", "田形": "田型"}
FILES_SEARCHED, RERANK_POOL, FUSION, RESERVE = 20, 15, 2, 5
BOOST_WORDS = "高程 标高 管径 坡比 造价 金额 投资 单价 任务量 指标 定额".split()
DATA_WORDS = "多少 参数 造价 指标 标准 投资 单价 定额 高程 管径 厚度 深度".split()


def asks_for_data(question: Column) -> Column:
    return question.rlike("|".join(DATA_WORDS))


def holds_parameter(question: Column, text: Column) -> Column:
    """True for texts with a digit and a word of parameters, one of the question's own if it has such words."""
    own = F.filter(F.array(*map(F.lit, BOOST_WORDS)), lambda w: question.contains(w))
    related = (F.size(own) == 0) | F.exists(own, lambda w: text.contains(w))
    return text.rlike("|".join(BOOST_WORDS)) & text.rlike(r"\d") & related


def hybrid_lists(queries: DataFrame, chunks: DataFrame, pool: int, query: str, allowed: DataFrame | None = None) -> list[DataFrame]:
    """Dense and sparse lists (query, doc_id, chunk_index, rank0) of the pool's size over chunks with document and embedding
    (null: not in the dense list); with allowed (query, doc_id) each query sees its own documents only."""
    rows = chunks.select(F.struct("doc_id", "chunk_index").alias("key"), F.col("document").alias("text"), "embedding")
    lists = []
    if "embedding" in queries.columns:
        dense = queries.filter("embedding is not null").select(query, "embedding")
        found = rows.filter("embedding is not null")
        if allowed is None:
            lists.append(dense_search(dense, found, pool, query, "key"))
        else:
            met = found.withColumn("doc_id", F.col("key.doc_id")).join(small(allowed), "doc_id").join(small(dense.withColumnRenamed("embedding", "qv")), query)
            lists.append(top_k(met.select(query, "key", dot(F.col("qv"), F.col("embedding")).alias("score")), query, pool, F.desc("score"), F.asc("key")))
    wanted = query_terms(queries, query)
    index = stored(postings(rows, "key", only=wanted).select("key", "term", "tf"))
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p(F.lit(float(max(1, chunks.count()))) / F.col("df"))
    met = index.join(small(wanted.join(frequency, "term").select(query, "term", idf.alias("idf"))), "term")
    if allowed is not None:
        met = met.withColumn("doc_id", F.col("key.doc_id")).join(small(allowed), [query, "doc_id"], "left_semi")
    scores = met.groupBy(query, "key").agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")), 6).alias("score"))
    lists.append(top_k(scores, query, pool, F.desc("score"), F.asc("key")))
    return [d.select(query, F.col("key.doc_id").alias("doc_id"), F.col("key.chunk_index").alias("chunk_index"), "rank0") for d in lists]


def hybrid_search(queries: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None, k: int = 5, width: int = 1, query: str = "query_id", ranker=None) -> DataFrame:
    """The k best passages of each query: (query, rank0, doc_id, chunk_index, score, document).

    queries: query, text[, embedding]; chunks and summaries (one chunk for each document that has one): doc_id, chunk_index,
    document, embedding. The stages: spelling; the summaries' best documents, where there are more than FILES_SEARCHED;
    dense and sparse lists of chunks, fused; of the first RERANK_POOL those that hold a parameter, for questions that ask for
    figures, before the others as ranker(hits, queries) orders them (default: by shared terms); neighbours; runs of neighbours
    joined; near copies left out. Scores are those of the fusion, neighbours' less."""
    queries = queries.withColumn("text", _spelled(F.col("text")))
    files = chunks.select("doc_id").distinct().count()
    allowed = None
    if summaries is not None and files > FILES_SEARCHED:
        best = 12 if files > 50 else 8
        lists = hybrid_lists(queries, summaries, best, query)
        first = top_k(fused(lists, query, ["doc_id", "chunk_index"], FUSION), query, best, F.desc("score"), F.asc("doc_id"), F.asc("chunk_index"))
        allowed = stored(prefiltered(first, files, query).distinct())
        files = best
    pool = pool_size(k, files)
    lists = hybrid_lists(queries, chunks, pool, query, allowed)
    hits = top_k(fused(lists, query, ["doc_id", "chunk_index"], FUSION), query, pool, F.desc("score"), F.asc("doc_id"), F.asc("chunk_index"))
    hits = hits.filter(F.col("rank0") < RERANK_POOL + RESERVE)
    hits = stored(hits.join(chunks.select("doc_id", "chunk_index", "document"), ["doc_id", "chunk_index"]))
    found = ordered_hits(hits, queries, k, query, ranker)
    wide = merged(expanded(found.select(query, "doc_id", "chunk_index", "score"), chunks, width, query), query)
    return accepted(wide, k, query)


def _spelled(text: Column) -> Column:
    for wrong, right in TYPOS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def ordered_hits(hits: DataFrame, queries: DataFrame, k: int, query: str = "query_id", ranker=None) -> DataFrame:
    """Hits (query, rank0, document, ...) of the pool: those that hold a parameter the question asks for, in their order, then
    as many of the others as make 2 k, as ranked. Where the whole pool is of the first kind, the reserve behind it is ranked."""
    q = queries.select(query, F.col("text").alias("__question"))
    d = hits.join(small(q), query)
    boosted = (F.col("rank0") < RERANK_POOL) & asks_for_data(F.col("__question")) & holds_parameter(F.col("__question"), F.col("document"))
    d = d.withColumn("__boosted", boosted)
    w = Window.partitionBy(query)
    others = F.sum(((F.col("rank0") < RERANK_POOL) & ~F.col("__boosted")).cast("int")).over(w)
    d = d.withColumn("__others", others).withColumn("__ahead", F.sum(F.col("__boosted").cast("int")).over(w))
    normal = ~F.col("__boosted") & F.when(F.col("__others") > 0, F.col("rank0") < RERANK_POOL).otherwise(F.col("rank0") >= RERANK_POOL)
    ahead, rest = d.filter("__boosted"), d.filter(normal)
    places = (ranker or lexical_order)(rest.select(query, "rank0", "document"), queries).select(query, "rank0", F.col("place").alias("__place"))
    rest = rest.join(places, [query, "rank0"], "left")
    rest = ranked(rest, query, F.asc_nulls_last("__place"), F.asc("rank0"), into="__at").filter(F.col("__at") < F.greatest(F.lit(2 * k) - F.col("__ahead"), F.lit(1)))
    extra = ("__question", "__boosted", "__others", "__ahead", "__place", "__at")
    return ahead.drop(*extra).unionByName(rest.drop(*extra))


def recommended_files(hits: DataFrame, query: str = "query_id", key: str = "doc_id", rows: int = 40, files: int = 10) -> DataFrame:
    """Files by the sum of 1 / (60 + rank) over a query's first rows."""
    s = hits.filter(F.col("rank0") < rows).groupBy(query, key).agg(F.round(F.sum(1 / (F.lit(60.0) + F.col("rank0"))), 9).alias("score"), F.count("*").alias("n_rows"))
    return top_k(s, query, files, F.desc("score"), F.asc(key))


def in_priority(parts: DataFrame, priority: dict[str, int], query: str = "query_id", kind: str = "kind", exact: tuple[str, ...] = ("sql", "cross_filter", "graph_qa"), limit: int = 25_000) -> DataFrame:
    """Parts of a context in order of priority, cut at the first part that does not fit the limit. Where SQL answered, only exact kinds stay."""
    p = F.lit(len(priority))
    for name, place in priority.items():
        p = F.when(F.col(kind) == name, place).otherwise(p)
    sql = F.max((F.col(kind) == "sql").cast("int")).over(Window.partitionBy(query))
    d = parts.withColumn("priority", p).withColumn("has_sql", sql).filter((F.col("has_sql") == 0) | F.col(kind).isin(*exact))
    order = Window.partitionBy(query).orderBy("priority", "part_no")
    d = d.withColumn("used", F.sum(F.length("document") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter(F.col("used") <= limit).drop("has_sql")


def table_search(hits: DataFrame, most: int, least: float = 0.35, gone: list | None = None, query: str = "query_id", table: str = "table_id") -> DataFrame:
    """The first tables of each query with a fused score that is high enough, some left out. With an inner constant of 2 a
    score of 0.35 takes a first place in one list or good ones in both."""
    d = hits.filter(F.col("score") >= least)
    if gone:
        d = d.filter(~F.col(table).isin(*gone))
    return top_k(d, query, most, F.desc("score"), F.asc(table))


# What is asked for the figures of a whole project.
GLOBAL_QUESTIONS = ("面积 价格 数据 统计 区片", "地价 标准 耕地 建设用地", "变化 幅度 修订 调整")


def global_questions(projects: DataFrame, project: str = "project_id", name: str = "name") -> DataFrame:
    """(project, question_no, text): the fixed questions of each project, with its name before them if it has one."""
    each = F.posexplode(F.array(*map(F.lit, GLOBAL_QUESTIONS)))
    d = projects.select(project, F.coalesce(F.col(name), F.lit("")).alias("__n"), each.alias("question_no", "text"))
    return d.select(project, "question_no", F.trim(F.concat_ws(" ", F.nullif("__n", F.lit("")), "text")).alias("text"))


def global_context(hits: DataFrame, rows: int = 3, most: int = 4, characters: int = 2000, project: str = "project_id") -> DataFrame:
    """(project, context): the first rows of each fixed question, equal chunks once (as the first question found them), the
    best of them by score, each behind its source's name (filename), cut to a length."""
    w = Window.partitionBy(project, "doc_id", "chunk_index").orderBy("question_no", "rank0")
    first = hits.filter(F.col("rank0") < rows).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    best = top_k(first.drop("rank0"), project, most, F.desc("score"), F.asc("doc_id"), F.asc("chunk_index"))
    part = F.concat(F.lit("[来源: "), F.coalesce("filename", F.lit("未知")), F.lit("]\n"), "document")
    parts = F.array_sort(F.collect_list(F.struct("rank0", part.alias("part"))))
    return best.groupBy(project).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").substr(1, characters).alias("context"))
