"""Joins, aggregates, windows, top-k, sets and filters that the engine's reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters ------------------------------------------------------------------------------------
def matching(df: DataFrame, must: dict | None = None, must_not: dict | None = None) -> DataFrame:
    """Rows whose columns equal a value or are among several, and are none of others; null is never excluded."""
    for name, wanted in (must or {}).items():
        df = df.filter(F.col(name).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    for name, unwanted in (must_not or {}).items():
        hit = F.col(name).isin(*unwanted) if isinstance(unwanted, (list, tuple, set)) else F.col(name) == unwanted
        df = df.filter(F.col(name).isNull() | ~hit)
    return df


def access(user: Column, role: Column, owner: Column, visibility: Column) -> Column:
    """rw for owners and administrators, r for public projects, none otherwise."""
    return F.when((user == owner) | (role == "admin"), "rw").when(visibility == "public", "r").otherwise("none")


def stale(updated: Column, now: Column, seconds: int = 1800) -> Column:
    return F.timestamp_diff("SECOND", updated, now) > seconds


# Words of messages of faults that are worth another try, suffixes that are taken in, bounds of sizes in bytes.
FAULTS = ("超时", "意外终止", "server busy", "connection", "ConnectError")
SUFFIXES = "txt md csv log json xml html htm pdf doc docx xlsx xls pptx caj dwg dxf shp dbf gdb mdb jpg jpeg png bmp tiff tif webp mp3 wav mp4 mov".split()
TOO_LARGE, SLOW, SLOW_SHEET = 1.5 * 1024**3, 2 * 1024**2, 1024**2
# States of files that do not count, with the reason a report gives.
EXCLUDED = {"empty_text": "未提取到文本 (可能是纯图扫描件)", "unsupported_format": "不支持的格式", "too_large": "文件体积过大", "failed": "解析过程失败"}


def retryable(status: Column, message: Column, retries: Column, faults: tuple[str, ...] = FAULTS, most: int = 3) -> Column:
    """Failed jobs whose message holds a word of a passing fault, and that were not tried again too often."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(message, F.lit("")).contains(f) for f in faults])
    return (status == "failed") & hit & (F.coalesce(retries, F.lit(0)) < most)


def admission(size: Column, name: Column, suffixes: list[str] | tuple[str, ...] = tuple(SUFFIXES)) -> Column:
    """too_large, unsupported_format, slow or fast: where an uploaded file goes."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(size > int(TOO_LARGE), "too_large")
        .when(~suffix.isin(*suffixes), "unsupported_format")
        .when((size > SLOW) | (suffix.isin("xlsx", "xls") & (size > SLOW_SHEET)), "slow")
        .otherwise("fast")
    )


def counted(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs that count as files: those of no excluded state. A null state counts."""
    return matching(jobs, must_not={status: list(EXCLUDED)})


def excluded(jobs: DataFrame, status: str = "status") -> DataFrame:
    """(status, reason, n) of the jobs that do not count."""
    reason = F.create_map(*[F.lit(x) for pair in EXCLUDED.items() for x in pair])
    g = jobs.filter(F.col(status).isin(*EXCLUDED)).groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return g.select("status", reason[F.col("status")].alias("reason"), "n")


def is_total_row(first: Column) -> Column:
    return first.rlike(r"^(合计|总计|小计)$") | first.rlike(r"^-+$") | first.rlike(r"^[（(]\d+[）)]$") | first.rlike(r"^(说明|注[：:])")


def row_class(cells: Column) -> Column:
    """empty, rule (dashes and colons only), index (（1）（2）...), note, total or data: what a row of a table is, by its filled cells."""
    full = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")

    def of(f: Column) -> Column:
        first = F.get(f, F.lit(0))
        return (
            F.when(F.size(f) == 0, "empty")
            .when(F.forall(f, lambda c: c.rlike(r"^[-:]*$")), "rule")
            .when(F.forall(f, lambda c: c.rlike(r"^[（(]\d+[）)]$")), "index")
            .when(first.rlike(r"^(说明|注[：:])"), "note")
            .when(first.isin("合计", "总计", "小计"), "total")
            .otherwise("data")
        )

    return F.element_at(F.transform(F.array(full), of), 1)  # a list of one binds the filled cells


def plot_variants(query: Column, pattern: str = r"地块\s*(\d+)#?") -> Column:
    """The numbers a query names, as they stand, without leading zeros, and with three digits."""
    raw = F.regexp_extract_all(query, F.lit(pattern), 1)
    forms = F.transform(raw, lambda v: F.array(v, F.regexp_replace(v, "^0+(?=.)", ""), F.when(F.length(v) >= 3, v).otherwise(F.lpad(v, 3, "0"))))
    return F.array_distinct(F.flatten(forms))


def holding_any(column: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: column.contains(v))


def keep_if_any(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that satisfy a condition, or all rows if none does."""
    found = df.filter(condition)
    return df if found.isEmpty() else found


# --- joins --------------------------------------------------------------------------------------
def looked_up(df: DataFrame, dimension: DataFrame, on: str, name: str, otherwise: str) -> DataFrame:
    """df with a dimension's name, a default where there is none. A broadcast is left to the size that Spark knows."""
    return df.join(dimension.select(on, name), on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(otherwise)))


def first_hit(keys: DataFrame, sources: list[DataFrame], on: str, value: str) -> DataFrame:
    """The value of the first source that has one, and which source it was."""
    rows = [s.select(on, value).withColumn("level", F.lit(k)) for k, s in enumerate(sources)]
    found = reduce(DataFrame.unionByName, rows).filter(F.col(value).isNotNull())
    found = found.groupBy(on).agg(F.min(F.struct("level", value)).alias("f"))
    return keys.join(found, on, "left").select(on, F.col(f"f.{value}").alias(value), F.col("f.level").alias("level"))


def ghosts(stores: dict[str, DataFrame], real: DataFrame, key: str) -> DataFrame:
    """(key, store): keys of the stores that the real table does not have."""
    rows = [s.select(key).distinct().join(real.select(key), key, "left_anti").withColumn("store", F.lit(n)) for n, s in stores.items()]
    return reduce(DataFrame.unionByName, rows)


def split_by(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their key among members, the others)."""
    return df.join(members.select(key), key, "left_semi"), df.join(members.select(key), key, "left_anti")


def references(refs: DataFrame, files: DataFrame, empty_is_all: bool = True) -> DataFrame:
    """(ref_id, library, file_id): listed files of each reference; an empty (or null) list means all files of the library, or
    none. Lists meet files on library and id; only references to whole libraries meet all files of theirs."""
    f = files.select("library", "file_id").distinct()
    listed = refs.select("ref_id", "library", F.explode("file_ids").alias("file_id")).distinct().join(f, ["library", "file_id"]).select("ref_id", "library", "file_id")
    if not empty_is_all:
        return listed
    whole = refs.filter(F.coalesce(F.size("file_ids"), F.lit(0)) <= 0).select("ref_id", "library").distinct()
    return listed.unionByName(whole.join(f, "library").select("ref_id", "library", "file_id")).distinct()


def without_ids(refs: DataFrame, gone: list[str]) -> DataFrame:
    """References without some ids; one whose list runs empty goes, one that was empty (all files) stays."""
    left = F.array_except("file_ids", F.array(*[F.lit(g) for g in gone]))
    return refs.filter((F.size("file_ids") == 0) | (F.size(left) > 0)).withColumn("file_ids", F.when(F.size("file_ids") == 0, F.col("file_ids")).otherwise(left))


def deleted_pairs(old: DataFrame, new: DataFrame, key: str, order: str, by: str) -> DataFrame:
    """Messages that are gone, and the reply (or question) next to each."""
    w = Window.partitionBy(by).orderBy(order)
    d = old.withColumn("next_role", F.lead("role").over(w)).withColumn("next_key", F.lead(key).over(w)).withColumn("prev_role", F.lag("role").over(w)).withColumn("prev_key", F.lag(key).over(w))
    partner = F.when((F.col("role") == "user") & (F.col("next_role") == "assistant"), F.col("next_key")).when((F.col("role") == "assistant") & (F.col("prev_role") == "user"), F.col("prev_key"))
    return d.withColumn("partner", partner).join(new.select(key), key, "left_anti").select(key, by, "role", "partner")


def best_titles(wanted: DataFrame, have: DataFrame, least: int = 1) -> DataFrame:
    """For each wanted title the one at hand with the most common pairs of characters, then the nearest length. Titles meet on
    a shared pair, so nothing is compared that has none; pairs that many titles hold are dealt over SALTS tasks."""
    pairs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: t.substr(i, F.lit(2))))
    a = wanted.select("wanted_id", F.col("title").alias("a"), F.explode(pairs(F.col("title"))).alias("g"))
    b = have.select("have_id", F.col("title").alias("b"), F.explode(pairs(F.col("title"))).alias("g"))
    both = salted_join(b, a, "g", "have_id").groupBy("wanted_id", "have_id", "a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    order = Window.partitionBy("wanted_id").orderBy(F.desc("shared"), F.abs(F.length("a") - F.length("b")), "have_id")
    return both.withColumn("r", F.row_number().over(order)).filter("r = 1").select("wanted_id", "have_id", "shared")


def titles_for(wanted: DataFrame, have: DataFrame, least: int = 2, characters: int = 3) -> DataFrame:
    """(wanted_id, have_id, by): the title at hand for each wanted one: by common pairs of characters, else the one of the same
    place (column `place`), else one that shares so many different characters, most first, then the least id."""
    pairs = best_titles(wanted, have, least).select("wanted_id", "have_id", F.lit(1).alias("rank"), F.lit("pairs").alias("by"))
    place = wanted.select("wanted_id", "place").join(have.select("have_id", "place"), "place").select("wanted_id", "have_id", F.lit(2).alias("rank"), F.lit("place").alias("by"))
    letters = lambda d, key: d.select(key, F.explode(F.array_distinct(F.split("title", ""))).alias("ch")).filter("trim(ch) <> ''")
    both = salted_join(letters(have, "have_id"), letters(wanted, "wanted_id"), "ch", "have_id").groupBy("wanted_id", "have_id").agg(F.count("*").alias("n")).filter(F.col("n") >= characters)
    best = Window.partitionBy("wanted_id").orderBy(F.desc("n"), "have_id")
    shared = both.withColumn("r", F.row_number().over(best)).filter("r = 1").select("wanted_id", "have_id", F.lit(3).alias("rank"), F.lit("characters").alias("by"))
    rows = pairs.unionByName(place).unionByName(shared)
    return rows.groupBy("wanted_id").agg(F.min(F.struct("rank", "have_id", "by")).alias("t")).select("wanted_id", "t.have_id", "t.by")


SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, on: str, spread: str) -> DataFrame:
    """Inner join on a column of which some values are frequent: rows of `large` are dealt over SALTS tasks by `spread`, and
    those of `small` go to each of them."""
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    return large.withColumn("__salt", F.pmod(F.xxhash64(F.lit(11), spread), F.lit(SALTS)).cast("int")).join(small.withColumn("__salt", salts), [on, "__salt"]).drop("__salt")


# --- aggregates ---------------------------------------------------------------------------------
def histogram(df: DataFrame, value: Column, edges: list[int]) -> DataFrame:
    """(bucket, n) over half-open buckets between edges, the last without end; empty buckets are there with 0."""
    names = [f"{a}-{b}" for a, b in zip(edges, edges[1:])] + [f"{edges[-1]}+"]
    bucket = F.lit(names[-1])
    for name, to in reversed(list(zip(names, edges[1:]))):
        bucket = F.when(value < to, name).otherwise(bucket)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return frame.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def once_per_block(df: DataFrame, value: str, block: str | None, by: list[str] | None = None) -> DataFrame:
    """Sum of a column with merged cells: a block whose values are all equal counts once, another its sum."""
    by = by or []
    g = df.groupBy(*by, *([block] if block else [])).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("s"))
    return g.groupBy(*by).agg(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("s"))).alias("total"))


def merged_columns(df: DataFrame, columns: list[str], group: str, least: int = 10, share: float = 0.3, single: float = 0.9) -> DataFrame:
    """(column, n, n_distinct, single_share, merged): numeric columns that repeat one value within most groups."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([group], columns, "column", "value").filter("value is not null")
    per = long.groupBy("column", group).agg(F.count("*").alias("n"), F.countDistinct("value").alias("k"))
    whole = long.groupBy("column").agg(F.countDistinct("value").alias("n_distinct"))
    out = per.groupBy("column").agg(F.sum("n").alias("n"), F.avg((F.col("k") == 1).cast("double")).alias("single_share")).join(whole, "column")
    merged = (F.col("n") >= least) & (F.col("n_distinct") / F.col("n") < share) & (F.col("single_share") >= single)
    return out.select("column", "n", "n_distinct", F.round("single_share", 6).alias("single_share"), merged.alias("merged"))


def long_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): all cells that are filled, as text."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return cells.filter("value is not null and trim(value) not in ('', '-', '—', '/')")


def profile_numeric(df: DataFrame, columns: list[str], share: float = 0.5, stated: Column | None = None) -> DataFrame:
    """One row for each column of which more than half the filled cells are numbers. One pass over all columns.

    stated: marks total rows; they are left out of the figures, and the number that one states for a column (the greatest,
    if there are several: subtotals are less) is its stated_total, which wins over the computed sum (total)."""
    if stated is not None:
        marked = df.withColumn("__total", F.coalesce(stated, F.lit(False)))
        given = long_cells(marked.filter("__total"), columns).groupBy("column").agg(F.max(F.expr("try_cast(value as double)")).alias("stated_total"))
        computed = profile_numeric(marked.filter("not __total").drop("__total"), columns, share)
        return computed.join(given, "column", "left").withColumn("total", F.coalesce("stated_total", "total"))
    cells = long_cells(df, columns).withColumn("number", F.expr("try_cast(value as double)"))
    p = cells.groupBy("column").agg(
        F.count("*").alias("filled"),
        F.count("number").alias("n"),
        F.countDistinct("value").alias("n_distinct"),
        F.round(F.sum("number"), 2).alias("total"),
        F.round(F.avg("number"), 4).alias("mean"),
        F.min("number").alias("least"),
        F.max("number").alias("most"),
    )
    return p.filter(F.col("n") > F.col("filled") * share).drop("filled")


def profile_categories(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, value, n, n_distinct, place): the most frequent values of each column, ties in order of value."""
    counts = long_cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column")
    d = counts.withColumn("n_distinct", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("bigint"))
    return d.filter(F.col("place") <= top)


# Words of column names that make a category or a measure worth summing, a measure of business or of area, and names of mere keys.
GROUP_WORDS = ("地类", "类型", "名称", "DLMC", "XZQMC", "权属", "LX", "分类", "类别")
SUM_WORDS = ("面积", "AREA", "MJ", "TBDLMQ", "金额", "长度", "LENGTH")
AREA_WORDS = ("面积", "AREA", "MJ", "TBDLMQ")
KEY_NAMES = ("BSM", "OBJECTID", "FID", "SHAPE")
SQUARE_METRES_PER_HECTARE, MU_PER_HECTARE = 10_000.0, 15.0


def named_like(columns: list[str], words: tuple[str, ...]) -> list[str]:
    """The columns whose name, in either case, holds one of the words."""
    return [c for c in columns if any(w in c or w in c.upper() for w in words)]


def with_area_units(value: Column, is_area: Column) -> Column:
    """A number as text; a large area in square metres with hectares and mu beside it."""
    two = lambda v: F.format_string("%.2f", v.cast("double"))
    hectares = value / SQUARE_METRES_PER_HECTARE
    wide = F.concat(two(value), F.lit(" (约 "), two(hectares), F.lit(" 公顷 / "), two(hectares * MU_PER_HECTARE), F.lit(" 亩)"))
    return F.when(is_area & (value > SQUARE_METRES_PER_HECTARE), wide).otherwise(two(value))


def auto_summary(df: DataFrame, categories: list[str] | None = None, measure: str | None = None, most: int = 100) -> DataFrame:
    """(category, value, total, n, shown): the sum of a measure by each of the first two categories, the largest groups of each: a
    top-k report. Categories and measure are chosen by their names unless given. Rows without a category are left out."""
    kinds = dict(df.dtypes)
    numbers = [c for c, t in kinds.items() if t.startswith(("int", "bigint", "smallint", "tinyint", "float", "double", "decimal"))]
    categories = (categories or named_like([c for c in df.columns if kinds[c] == "string"], GROUP_WORDS))[:2]
    measure = measure or next(iter(named_like(numbers, SUM_WORDS)), None)
    if not categories or not measure:
        return df.sparkSession.createDataFrame([], "category string, value string, total double, n bigint, shown string")
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in categories], F.col(measure).cast("double").alias("__m"))
    cells = cells.unpivot(["__m"], categories, "category", "value").filter("value is not null")
    g = cells.groupBy("category", "value").agg(F.round(F.sum("__m"), 2).alias("total"), F.count("*").alias("n"))
    order = Window.partitionBy("category").orderBy(F.desc("total"), "value")
    g = g.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")
    return g.withColumn("shown", with_area_units(F.col("total"), F.lit(bool(named_like([measure], AREA_WORDS)))))


def business_profile(df: DataFrame, words: tuple[str, ...], many: int = 200, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(numeric columns named by business words: column, n, total, most, mean; text columns but keys: column, n_distinct,
    value, n, place): the most frequent values of a text column, or none of them where it has too many different ones."""
    kinds = dict(df.dtypes)
    numbers = named_like([c for c, t in kinds.items() if t.startswith(("int", "bigint", "smallint", "tinyint", "float", "double", "decimal"))], words)
    texts = [c for c, t in kinds.items() if t == "string" and c.upper() not in KEY_NAMES]
    spark = df.sparkSession
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "value").filter("value is not null and not isnan(value)")
        numeric = long.groupBy("column").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"))
    else:
        numeric = spark.createDataFrame([], "column string, n bigint, total double, most double, mean double")
    if not texts:
        return numeric, spark.createDataFrame([], "column string, n_distinct bigint, value string, n bigint, place bigint")
    counts = df.select(*texts).unpivot([], texts, "column", "value").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column")
    d = counts.withColumn("n_distinct", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("bigint"))
    shown = F.col("n_distinct") <= many
    d = d.filter(F.when(shown, F.col("place") <= top).otherwise(F.col("place") == 1))
    return numeric, d.select("column", "n_distinct", F.when(shown, F.col("value")).alias("value"), F.when(shown, F.col("n")).alias("n"), F.when(shown, F.col("place")).alias("place"))


# The three scores that a judge gives an answer.
JUDGED = ("context_relevance", "groundedness", "answer_relevance")


def daily_scores(traces: DataFrame, at: str = "created_at", scores: tuple[str, ...] = JUDGED) -> DataFrame:
    """(day, n, mean of each score): scores are numbers or text, kept within 0 and 1, a half where there is no number."""
    from brindle.functions.nlp import judged

    means = [F.round(F.avg(judged(F.col(s).cast("string"))), 6).alias(s) for s in scores]
    return traces.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), *means)


def chunk_stats(chunks: DataFrame, key: str = "doc_id", kind: str = "chunk_type", left_out: tuple[str, ...] = ("doc_summary",), full: int = 512) -> DataFrame:
    """(key, chunks, chars, has_full) of each file, without chunks of kinds that only stand for the file."""
    g = matching(chunks, must_not={kind: list(left_out)}).groupBy(key)
    return g.agg(F.count("*").alias("chunks"), F.sum(F.length("document")).alias("chars"), F.bool_or(F.length("document") >= full).alias("has_full"))


def rolled_up(jobs: DataFrame, by: list[str], status: str, at: str) -> DataFrame:
    """Counts by status, percent done, last change and a state of the whole."""
    n = lambda s: F.count_if(F.col(status) == s)
    g = jobs.groupBy(*by).agg(F.count("*").alias("total"), n("done").alias("done"), n("failed").alias("failed"), n("running").alias("running"), F.max(at).alias("updated_at"))
    state = F.when(F.col("running") > 0, "running").when(F.col("done") == F.col("total"), "done").when(F.col("failed") > 0, "partial").otherwise("waiting")
    percent = F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("done") / F.col("total") * 100, 2))
    return g.withColumn("percent", percent).withColumn("state", state)


# --- windows ------------------------------------------------------------------------------------
def latest(df: DataFrame, key: str, *version: Column) -> DataFrame:
    """The last version of each key: an upsert."""
    w = Window.partitionBy(key).orderBy(*[v.desc_nulls_last() for v in version])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def within_budget(df: DataFrame, by: str, size: Column, limit: int, *order: Column) -> DataFrame:
    """Rows in order while their running size stays within a limit; the first that does not fit ends it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= limit)


def until_failures(df: DataFrame, by: str, order: str, failed: Column, most: int = 3) -> DataFrame:
    """Rows up to the one that completes a run of so many failures."""
    w = Window.partitionBy(by).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__f", failed.cast("int")).withColumn("__g", F.sum(1 - F.col("__f")).over(past))
    d = d.withColumn("streak", F.sum("__f").over(Window.partitionBy(by, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__hit", F.max((F.col("streak") >= most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.filter(F.coalesce("__hit", F.lit(0)) == 0).drop("__f", "__g", "__hit")


def ttl_hits(df: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """df with hit: the same key was asked within so many seconds before."""
    before = F.lag(at).over(Window.partitionBy(*key).orderBy(at, "event_id"))
    return df.withColumn("hit", F.coalesce(F.timestamp_diff("SECOND", before, F.col(at)) <= seconds, F.lit(False)))


# Seconds that answers stay in each cache; entries that a small cache holds, and how many of the oldest go when it is full.
TTL = {"retrieval": 1800, "answer": 3600, "model": 86_400, "rewrite": 300, "intent": 300}
CACHE_ENTRIES, CACHE_EVICTED = 200, 100


def cache_entries(entries: DataFrame, now: Column, cache: Column, key: str = "key", at: str = "ts", entries_kept: int = CACHE_ENTRIES, evicted: int = CACHE_EVICTED) -> DataFrame:
    """Entries of caches (cache names one of TTL) that are still there: within their time to live, the last of each key, and
    where a cache grew past its bound, without those that went as the oldest each time it did."""
    ttl = F.create_map(*[F.lit(x) for pair in TTL.items() for x in pair])
    d = entries.withColumn("__cache", cache).withColumn("__r", F.row_number().over(Window.partitionBy(cache, key).orderBy(F.desc(at)))).filter("__r = 1")
    # With n entries in order of age, every `evicted` past the bound lets as many of the oldest go.
    w = Window.partitionBy("__cache")
    d = d.withColumn("__n", F.count("*").over(w)).withColumn("__age", F.row_number().over(w.orderBy(F.asc(at), F.asc(key))))
    gone = F.greatest(F.ceil((F.col("__n") - entries_kept) / evicted), F.lit(0)) * evicted
    d = d.filter(F.col("__age") > gone).filter(F.timestamp_diff("SECOND", F.col(at), now) <= ttl[F.col("__cache")])
    return d.drop("__cache", "__r", "__n", "__age")


def invalidated(entries: DataFrame, gone: DataFrame, project: str = "project_id") -> DataFrame:
    """Entries without those of projects whose files changed."""
    return entries.join(gone.select(project).distinct(), project, "left_anti")


# --- sets ---------------------------------------------------------------------------------------
def unsupported_numbers(answer: Column, sources: Column, least: float = 10, most: int = 3, severe: float = 1000) -> Column:
    """Array of (number, severe) that an answer states and no source does; days, years and round numbers are common knowledge."""
    found = F.array_except(F.regexp_extract_all(answer, F.lit(r"\d+(?:\.\d+)?"), 0), F.regexp_extract_all(sources, F.lit(r"\d+(?:\.\d+)?"), 0))
    number = lambda v: v.try_cast("double")
    odd = F.filter(found, lambda v: (number(v) >= least) & ~((number(v) == F.floor(number(v))) & (number(v).between(0, 31) | number(v).between(1990, 2034) | number(v).isin(100.0, 1000.0, 10000.0))))
    rows = F.array_sort(F.transform(odd, lambda v: F.struct((-number(v)).alias("k"), v.alias("number"))))
    return F.transform(F.slice(rows, 1, most), lambda r: F.struct(r["number"].alias("number"), (-r["k"] > severe).alias("severe")))


def pairs_of(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: text.substr(i, F.lit(2)))))


def digits_differ(a: Column, b: Column) -> Column:
    """True if a pair of characters that only one of them has holds a digit."""
    only = F.concat(F.array_except(pairs_of(a), pairs_of(b)), F.array_except(pairs_of(b), pairs_of(a)))
    return F.exists(only, lambda g: g.rlike("[0-9]"))


def characters_alike(a: Column, b: Column, share: float = 0.8) -> Column:
    sa, sb = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    both, most = F.size(F.array_intersect(sa, sb)), F.greatest(F.size(sa), F.size(sb))
    return F.when(most < 4, both > 1).otherwise(both / most >= share)


def same_entity_candidate(a: Column, b: Column) -> Column:
    """Names that may mean one thing: one holds the other, or few edits (Latin) or mostly the same characters apart."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    latin = ~F.concat(a, b).rlike(r"[^\x00-\xff]")
    near = F.when(latin, F.levenshtein(F.lower(a), F.lower(b)) <= F.floor(F.length(short) / 2)).otherwise(characters_alike(a, b))
    return (a != b) & ~digits_differ(a, b) & ((long.contains(short) & (F.length(short) >= 2)) | near)


def deferred(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs that wait: their project is paused, or another project of first priority has active work and theirs has not that
    priority. projects: project_id, is_paused, priority, active."""
    j = jobs.join(projects, "project_id", "left")
    busy = projects.filter((F.coalesce("priority", F.lit(2)) == 1) & (F.col("active") > 0)).agg((F.count("*") > 0).alias("busy"))
    j = j.join(F.broadcast(busy))  # a single value
    return j.filter(F.coalesce("is_paused", F.lit(False)) | (F.col("busy") & (F.coalesce("priority", F.lit(2)) != 1))).select(*jobs.columns)


def head_rows(df: DataFrame, key: str, order: str, rows: int = 15, columns: int = 8) -> DataFrame:
    """The first rows and columns of each group: the sample that stands for a sheet. The group's key and order stay with it."""
    w = Window.partitionBy(key).orderBy(order)
    shown = [c for c in df.columns if c not in (key, order)][:columns]
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= rows).select(key, order, *shown)


def spread_rows(df: DataFrame, key: str, order: str, most: int = 15) -> DataFrame:
    """A sample of each group's rows for a summary: evenly spaced in their order, the first one included."""
    w = Window.partitionBy(key)
    d = df.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return d.filter(F.col("__r") % step == 0).drop("__r", "__n")


def natural_order(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows in the order a reader expects: numbers by value, with thousands separators, before other text; empty cells last."""
    number = F.expr(f"try_cast(replace(`{column}`, ',', '') as double)")
    empty = F.coalesce(F.trim(column), F.lit("")) == ""
    sort = (lambda c: c.asc_nulls_last()) if ascending else (lambda c: c.desc_nulls_last())
    return df.orderBy(empty, sort(number), sort(F.col(column)))


def document_listing(documents: DataFrame) -> DataFrame:
    """(id, title, n_sections, updated_at) of saved documents, newest first, without their bodies."""
    return documents.select("id", "title", F.size("sections").alias("n_sections"), "updated_at").orderBy(F.desc("updated_at"), "id")
