"""Tables taken out of files: matrices to headers and rows, typing, and filters across tables."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.operators.relational import holding_any, is_total_row, once_per_block
from brindle.operators.search import small
from brindle.session import dropped, stored

# Words of rows of titles, of units and of headers.
TITLE_WORDS = "汇总表 统计表 一览表 明细表 计算表 成果表 调查表 情况表".split()
UNIT_WORD, UNITS = "单位", "公顷 亩 平方 万元 元 吨 kg".split()
HEADER_WORDS = "行政区域 名称 代码 面积 编号 序号 类型 地类 用途 权属 坐落 单位名称 乡镇 项目 产量 产值 数量".split()


def cells_of(matrices: DataFrame, key: str = "table_id", rows: str = "rows") -> DataFrame:
    """(key, r, c, value) of an array of arrays; indices from 0, nan and none become empty."""
    d = matrices.select(key, F.posexplode(rows).alias("r", "row")).select(key, "r", F.posexplode("row").alias("c", "value"))
    return d.withColumn("value", F.when(F.lower(F.trim("value")).isin("nan", "none"), "").otherwise(F.coalesce(F.trim("value"), F.lit(""))))


def trimmed(cells: DataFrame, key: str = "table_id", most_rows: int | None = None, most_columns: int | None = None) -> DataFrame:
    """Cells without trailing empty rows and columns; row and column limits are opt-in, as the reader of a report wants them."""
    used = cells.filter("value <> ''").groupBy(key).agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    d = cells.join(used, key).filter("r <= mr and c <= mc").drop("mr", "mc")
    if most_rows is not None:
        d = d.filter(F.col("r") < most_rows)
    if most_columns is not None:
        d = d.filter(F.col("c") < most_columns)
    return d


def merged_filled(cells: DataFrame, ranges: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells of merged ranges (key, r0, c0, r1, c1) take the value of the top left one. The range join is an equality join
    on the places of the ranges."""
    places = ranges.select(key, "r0", "c0", F.explode(F.expr("sequence(r0, r1)")).alias("r"), "c1").select(key, "r0", "c0", "r", F.explode(F.expr("sequence(c0, c1)")).alias("c"))
    tops = cells.select(key, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("value").alias("top"))
    filled = places.join(tops, [key, "r0", "c0"]).select(key, "r", "c", "top")
    return cells.join(filled, [key, "r", "c"], "full").select(key, "r", "c", F.coalesce("top", "value").alias("value"))


def merged_column_numbers(ranges: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, c): columns that a vertical merge covers."""
    return ranges.filter("r1 > r0").select(key, F.explode(F.expr("sequence(c0, c1)")).alias("c")).distinct()


def rows_of(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, r, row): cells put together again, in order of columns."""
    g = cells.groupBy(key, "r").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("x"))
    return g.select(key, "r", F.transform("x", lambda e: e["value"]).alias("row"))


def filled_cells(row: Column) -> Column:
    return F.size(F.filter(row, lambda v: v != ""))


def row_kind(row: Column, words: list[str] | None = None) -> Column:
    """empty, title, unit (at most three filled cells), header, merged (a header word, but one value all along) or other."""
    full = F.filter(F.transform(row, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    said = F.array_join(F.filter(row, lambda v: v.isNotNull()), " ")
    return (
        F.when(F.size(full) == 0, "empty")
        .when(said.rlike("|".join(TITLE_WORDS)), "title")
        .when(said.contains(UNIT_WORD) & said.rlike("|".join(UNITS)) & (F.size(full) <= 3), "unit")
        .when(~said.rlike("|".join(words or HEADER_WORDS)), "other")
        .when(F.size(F.array_distinct(full)) == 1, "merged")
        .otherwise("header")
    )


def with_headers(rows: DataFrame, key: str = "table_id", within: int = 20) -> DataFrame:
    """(key, headers, columns, unit, title, first) of the tables. Header rows are looked for among the first rows, from the first one to the last
    before a row of another kind; without any, the first filled one of the first five rows is the header. The names in a column, each
    once, are joined with an underscore, the last two of them. Columns without a name are left out; columns holds the places of the others.
    Title and unit (empty if there is none) are those found last before the search ends."""
    d = rows.filter(F.col("r") < within).withColumn("kind", row_kind(F.col("row")))
    g = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "kind", "row"))).alias("a"))
    least = lambda of: F.array_min(F.transform(of, lambda x: x["r"]))
    g = g.withColumn("begin", least(F.filter("a", lambda x: x["kind"] == "header")))
    g = g.withColumn("stop", F.coalesce(least(F.filter("a", lambda x: (x["kind"] == "other") & (x["r"] > F.col("begin")))), F.lit(within)))
    g = g.withColumn("end", F.array_max(F.transform(F.filter("a", lambda x: (x["kind"] == "header") & (x["r"] < F.col("stop"))), lambda x: x["r"])))
    plain = F.coalesce(least(F.filter("a", lambda x: (x["r"] < 5) & (x["kind"] != "empty"))), F.lit(0))
    g = g.withColumn("begin", F.coalesce("begin", plain)).withColumn("end", F.coalesce("end", "begin"))
    g = g.withColumn("h", F.transform(F.filter("a", lambda x: x["r"].between(F.col("begin"), F.col("end"))), lambda x: x["row"]))
    width = F.greatest(F.coalesce(F.array_max(F.transform("h", F.size)), F.lit(1)), F.lit(1))
    tidy = lambda v: F.trim(F.replace(F.coalesce(v, F.lit("")), F.lit("\n"), F.lit("")))
    parts = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.filter(F.array_distinct(F.transform("h", lambda h: tidy(F.get(h, c)))), lambda v: v != ""))
    names = F.transform(parts, lambda p, c: F.struct(F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), "_").alias("name"), c.alias("c")))
    g = g.withColumn("n", F.filter(names, lambda n: n["name"] != ""))

    def said(kind: str) -> Column:
        row = F.element_at(F.filter("a", lambda x: (x["kind"] == kind) & (x["r"] < F.col("stop"))), -1)["row"]
        return F.coalesce(F.get(F.filter(F.transform(row, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""), F.lit(0)), F.lit(""))

    with_any = lambda kind: F.when(F.exists("a", lambda x: (x["kind"] == kind) & (x["r"] < F.col("stop"))), said(kind)).otherwise("")
    return g.select(key, F.transform("n", lambda n: n["name"]).alias("headers"), F.transform("n", lambda n: n["c"]).alias("columns"), with_any("unit").alias("unit"), with_any("title").alias("title"), (F.col("end") + 1).alias("first"))


def data_rows(rows: DataFrame, heads: DataFrame, key: str = "table_id", least: int = 2) -> DataFrame:
    """Rows below the header, their named columns only, that are not empty, of tables with enough of them. nan and none are empty cells."""
    value = lambda v: F.when(F.lower(F.trim(v)).isin("nan", "none"), "").otherwise(F.coalesce(F.trim(v), F.lit("")))
    d = rows.join(heads.select(key, "first", "columns"), key).filter(F.col("r") >= F.col("first"))
    d = d.withColumn("row", F.transform("columns", lambda c: value(F.get("row", c)))).drop("first", "columns").filter(filled_cells(F.col("row")) > 0)
    enough = d.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return d.join(enough.select(key), key, "left_semi")


def merged_names(heads: DataFrame, ranges: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, names): names of the columns that a vertical merge covers, in order, each once."""
    named = heads.select(key, F.explode(F.arrays_zip("columns", "headers")).alias("z")).select(key, F.col("z.columns").alias("c"), F.col("z.headers").alias("name"))
    met = named.join(merged_column_numbers(ranges, key), [key, "c"]).groupBy(key, "name").agg(F.min("c").alias("c"))
    return met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "name"))), lambda x: x["name"]).alias("names"))


def row_text(headers: Column, row: Column) -> Column:
    """header: value | ... of the cells that are filled."""
    parts = F.zip_with(headers, row, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.coalesce(h, F.lit("")), F.lit(": "), v)))
    return F.array_join(F.array_compact(parts), " | ")


def without_neighbour_repeats(row: Column, width: Column | None = None) -> Column:
    """A row whose equal neighbours are one, padded to a width."""
    kept = F.transform(F.filter(F.transform(row, lambda v, i: F.struct(v.alias("v"), F.get(row, i - 1).alias("b"), i.alias("i"))), lambda e: (e["i"] == 0) | (e["v"] != e["b"])), lambda e: e["v"])
    return kept if width is None else F.concat(kept, F.array_repeat(F.lit(""), F.greatest(width - F.size(kept), F.lit(0))))


def is_false_table(rows: Column) -> Column:
    """True for layout that only looks like a table: mostly empty, one populated column, no data, or cells of prose."""
    cells = F.flatten(rows)
    full = F.filter(cells, lambda v: v != "")
    columns = F.transform(F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(rows, F.size)) - 1, F.lit(0))), lambda c: F.exists(rows, lambda r: F.coalesce(F.get(r, c), F.lit("")) != ""))
    return (
        (F.size(rows) < 2)
        | (F.size(full) / F.greatest(F.size(cells), F.lit(1)) < 0.5)
        | (F.size(F.filter(columns, lambda x: x)) < 2)
        | F.exists(full, lambda v: (F.length(v) > 20) & v.rlike("[。；、，]"))
    )


def markdown_rows(text: Column) -> Column:
    """Array of rows of a markdown table, without its rule line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line).startswith("|") & ~line.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda v: F.trim(v)))


def markdown_of(headers: Column, rows: Column) -> Column:
    """A markdown table: line ends and bars escaped, rows padded or cut to the header."""
    clean = lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("&#124;"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fit = lambda r: F.transform(headers, lambda _, c: clean(F.get(r, c)))
    return F.array_join(F.concat(F.array(line(F.transform(headers, clean)), line(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, lambda r: line(fit(r)))), "\n")


def typed(df: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame | None:
    """df (of strings) with the columns of which over half the filled cells are numbers as doubles; None for a table of
    fewer rows. Two passes: the shares, then one projection."""
    number = lambda c: F.expr(f"try_cast(replace(`{c}`, ',', '') as double)")
    full = lambda c: F.count(F.when(F.trim(F.col(c)) != "", 1))
    r = df.agg(F.count("*").alias("n"), *[(F.count(number(c)) / F.greatest(full(c), F.lit(1))).alias(c) for c in df.columns]).first()
    if r["n"] < least:
        return None
    return df.select(*[number(c).alias(c) if r[c] > share else F.col(c) for c in df.columns])


def schema_summary(df: DataFrame, group: str | None = None, sample: int = 0) -> DataFrame:
    """(column, type, n, filled, n_distinct) for each column of a table; with a group column also merged (it repeats one value
    within most groups, so plain sums count it too often), with a sample its first values, in order of value."""
    from brindle.operators.relational import merged_columns

    t = dict(df.dtypes)
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, t[c])])
    g = cells.groupBy("column").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.countDistinct("value").alias("n_distinct"))
    out = g.select("column", kind[F.col("column")].alias("type"), "n", "filled", "n_distinct")
    if sample:
        first = cells.filter("value is not null").distinct().withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("r") <= sample)
        first = first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("sample"))
        out = out.join(first, "column", "left")
    if group:
        numbers = [c for c in df.columns if c != group and t[c] in ("int", "bigint", "float", "double")]
        flags = merged_columns(df, numbers, group).select("column", "merged") if numbers else df.sparkSession.createDataFrame([], "column string, merged boolean")
        out = out.join(flags, "column", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    return out


def cross_filter(rows: DataFrame, id_column: str, variants: list[str], words: list[str], value: str, block: str | None) -> DataFrame:
    """The total of a column over the rows that a question names: by forms of an id, then by words where some row has
    one, total rows left out, merged cells counted once."""
    d = rows.filter(~F.coalesce(is_total_row(F.col(id_column)), F.lit(False)))
    if variants:
        d = d.filter(holding_any(F.col(id_column), F.array(*[F.lit(v) for v in variants])))
    if words:
        whole = F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])
        hit = d.filter(whole.rlike("|".join(words)))
        d = d if hit.isEmpty() else hit
    return once_per_block(d, value, block)


def first_answer(tables: list[tuple[str, DataFrame]], id_column: str, variants: list[str], words: list[str], value: str, block: str | None) -> tuple[str | None, DataFrame | None]:
    """(name, total) of the first table, in their order, that has rows for a question; (None, None) if none has."""
    for name, rows in tables:
        found = cross_filter(rows, id_column, variants, words, value, block if block in rows.columns else None)
        if found.filter("total is not null").head(1):
            return name, found
    return None, None


# The number before a table's title, places in it, and the least characters of a title to match by.
TITLE_NUMBER = r"^[续附]?表[\d\-.]*\s*"
TITLE_PLACE = "[一-龥]{1,8}(?:省|市|县|区|镇|乡|村|街道|社区)"
TITLE_CHARACTERS = 3


def title_core(title: Column) -> Column:
    """A table's title without its number, places, what is in brackets and blanks."""
    t = F.regexp_replace(F.regexp_replace(title, TITLE_NUMBER, ""), TITLE_PLACE, "")
    return F.regexp_replace(F.regexp_replace(t, "[（(][^）)]*[）)]", ""), r"\s+", "")


def _bag(title: Column) -> Column:
    """The characters of a title, each with its number among equal ones: two titles share as many as their bags of characters do."""
    chars = F.split(title, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b)], dtype="float64")


def alike_titles(wanted: DataFrame, have: DataFrame, by: str, least: float) -> DataFrame:
    """(by, wanted_title, have_title, ratio): pairs of different spellings (by, title), distinct in each table, that are alike to the least ratio.

    A pair shares at least least * both lengths / 2 characters, so at least least / (2 - least) of either title's; with characters in
    one order, rarest first, such titles share one among the first ones of each. Only titles that do meet, and only those that share
    enough characters in all are compared in full."""
    share = least / (2 - least)
    frequent = have.select(F.explode(_bag(F.col("title"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))

    def first_ones(titles: DataFrame, name: str) -> DataFrame:
        c = titles.select(by, "title", F.explode(_bag(F.col("title"))).alias("c")).join(small(frequent), "c", "left")
        c = c.groupBy(by, "title").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "c"))).alias("cs"))
        c = c.select(by, F.col("title").alias(name), F.transform("cs", lambda x: x["c"]).alias(f"{name}_bag"))
        n = F.size(f"{name}_bag")
        return c.withColumn("c", F.explode(F.slice(f"{name}_bag", F.lit(1), (n - F.ceil(n * share - 1e-9) + 1).cast("int"))))

    met = first_ones(wanted, "wanted_title").join(first_ones(have, "have_title"), [by, "c"])
    both = F.size("wanted_title_bag") + F.size("have_title_bag")
    met = met.filter(2 * F.size(F.array_intersect("wanted_title_bag", "have_title_bag")) >= least * both - 1e-6)
    return met.select(by, "wanted_title", "have_title").distinct().withColumn("ratio", _ratio("wanted_title", "have_title")).filter(F.col("ratio") >= least)


def matched_titles(wanted: DataFrame, have: DataFrame, by: str = "project_id", least: float = 0.55, most_rounds: int = 1000) -> DataFrame:
    """(by, wanted_id, have_id, ratio): as if in order of wanted_id each title took the most alike one that is still free.

    In rounds: each title asks for the spelling it likes best; a spelling that n tables have keeps its first n askers, and turns down
    all titles behind the last of them for good; those ask elsewhere. The titles' order is the same for all spellings, so that ends where the
    sequence would. A round is a few joins over the pairs that are left. RuntimeError if it takes more than most_rounds.

    Defined cases: cores of under three characters and null titles or ids match nothing; of spellings equally alike (to six places) the one
    whose least have_id is least comes first; tables of one spelling are given out in order of have_id; ids are those of one
    title in a project; empty tables give no rows."""
    core = lambda d, c: d.select(by, c, title_core(F.col("title")).alias("title")).filter((F.length("title") >= TITLE_CHARACTERS) & F.col(c).isNotNull() & F.col(by).isNotNull())
    w, h = stored(core(wanted, "wanted_id")), stored(core(have, "have_id"))
    spellings = h.groupBy(by, "title").agg(F.count("*").alias("n"), F.min("have_id").alias("least_id"))
    alike = alike_titles(w.select(by, "title").distinct(), spellings.select(by, "title"), by, least)
    pairs = alike.join(spellings.withColumnRenamed("title", "have_title"), [by, "have_title"]).join(w.withColumnRenamed("title", "wanted_title"), [by, "wanted_title"])
    pairs = stored(pairs.select(by, "wanted_id", "have_title", "ratio", "n", "least_id"))
    liked = Window.partitionBy(by, "wanted_id").orderBy(F.desc("ratio"), "least_id")
    asking = Window.partitionBy(by, "have_title").orderBy("wanted_id")
    for _ in range(most_rounds):
        asked = pairs.withColumn("r", F.row_number().over(liked)).filter("r = 1").withColumn("place", F.row_number().over(asking))
        asked = stored(asked.select(by, "wanted_id", "have_title", "ratio", "n", "place"))
        if not asked.filter("place > n").head(1):
            break
        last = asked.filter("place = n").select(by, "have_title", F.col("wanted_id").alias("last"))
        left = stored(pairs.join(last, [by, "have_title"], "left").filter(F.col("last").isNull() | (F.col("wanted_id") <= F.col("last"))).drop("last"))
        dropped(pairs, asked)
        pairs = left
    else:
        raise RuntimeError(f"titles still ask after {most_rounds} rounds")
    dropped(pairs)
    given = h.select(by, F.col("title").alias("have_title"), "have_id", F.row_number().over(Window.partitionBy(by, "title").orderBy("have_id")).alias("place"))
    return asked.join(given, [by, "have_title", "place"]).select(by, "wanted_id", "have_id", "ratio")
