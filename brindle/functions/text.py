"""Text projections: chunking, tagging, scoring and trimming of document text, as columns."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Domain words whose presence makes a chunk credible, marks that are not noise, table and heading patterns.
DOMAIN_TERMS = (
    "保护层 钢筋 混凝土 设计 施工 标高 桩号 地基 基础 挡墙 排水 边坡 管道 涵洞 渠道 断面 土方 填方 挖方 坡度 坡比 图例 比例尺 说明 "
    "面积 地类 耕地 林地 建设用地 规划 等值线 降雨量 暴雨 径流 流域 高程 多年平均 变差系数 频率 均值 水文 气象 等降雨 参数 统计 水系 水库 水位"
).split()
PLAIN_MARKS = "，。、；：！？\"'（）《》【】\n\t .-·/%+="
TABLE_ROW = r"^\s*\|.*\|\s*$"
SENTENCE_CUT = r"(?<=[。！？；\n])"
HEADING = r"^(#{1,6}\s+\S|第[一二三四五六七八九十]+[章节条款篇])"
LIST_ITEM = r"^\s*([-*+]|\d+\.)\s+\S"
NUMERALS = "一二三四五六七八九十百千万"
SPACES = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- chunking -----------------------------------------------------------------------------------
def window_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Fixed windows that start every size - overlap characters, trimmed, blank ones dropped."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    found = F.transform(starts, lambda i: F.trim(text.substr(i + 1, F.lit(size))))
    return F.filter(found, lambda c: c != "")


def _fill(pieces: list[str], fits, glue: str) -> list[str]:
    """Neighbours joined while fits(length so far, piece) allows it."""
    out: list[str] = []
    for piece in pieces:
        if out and out[-1] and fits(len(out[-1]), piece):
            out[-1] += glue + piece
        else:
            out.append(piece)
    return out


def paragraph_chunks(text: str | None, target: int = 512, longest: int = 1200, least: int = 20) -> list[str]:
    """Chunks along blank lines, tables kept whole: blocks become runs of table or other lines, long runs of prose
    are cut behind sentence ends, and small neighbours are joined up to the target size."""
    atoms: list[str] = []
    is_table = re.compile(TABLE_ROW).match
    for block in (text or "").split("\n\n"):
        for table, lines in groupby(block.strip().split("\n"), key=lambda line: bool(is_table(line))):
            atom = "\n".join(lines).strip()
            if not atom:
                continue
            if table or is_table(atom.split("\n", 1)[0]) or len(atom) <= longest:
                atoms.append(atom)
            else:
                sentences = [s for s in re.split(SENTENCE_CUT, atom) if s.strip()]
                atoms += [a for a in map(str.strip, _fill(sentences, lambda n, s: n + len(s) <= target, "")) if a]
    merged = _fill(atoms, lambda n, a: n + len(a) + 2 <= target, "\n\n")
    return [c for c in map(str.strip, merged) if len(c) >= least]


def paragraph_chunk_column(text: Column, target: int = 512, longest: int = 1200, least: int = 20) -> Column:
    """The order-dependent fold of paragraph_chunks, a batch of rows at a time."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paragraph_chunks(t, target, longest, least))

    return chunks(text)


def section_pieces(text: str | None, target: int = 3000, heading: int = 40) -> list[str]:
    """A long section cut at short lines that are no table rows, filled up to the target, longer pieces cut hard."""
    groups: list[str] = []
    for line in (text or "").split("\n"):
        short = 0 < len(line.strip()) <= heading and not line.strip().startswith("|")
        if short or not groups:
            groups.append(line)
        else:
            groups[-1] += "\n" + line
    filled = _fill(groups, lambda n, g: n + len(g) + 1 <= target, "\n")
    return [piece[i : i + target] for piece in filled for i in range(0, max(1, len(piece)), target)]


def section_piece_column(text: Column, target: int = 3000, heading: int = 40) -> Column:
    """section_pieces, a batch of rows at a time."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: section_pieces(t, target, heading))

    return pieces(text)


def explode_chunks(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, total_chunks, document) with equal chunks of a document kept once, the first one."""
    kept = docs.select(key, F.array_distinct(F.transform(chunks, stripped)).alias("c"))
    return kept.select(key, F.posexplode("c").alias("chunk_index", "document"), F.size("c").alias("total_chunks"))


def context_prefix(chunks: DataFrame, name: Column, key: str = "doc_id", length: int = 60) -> DataFrame:
    """chunks with contextual: the document's name and the head of the chunk before."""
    before = F.lag("document").over(Window.partitionBy(key).orderBy("chunk_index"))
    head = F.concat(F.lit("[文档："), name, F.lit("]"))
    hint = F.concat(F.lit(" 前文："), F.regexp_replace(before.substr(1, length), "\n", " "), F.lit("…"))
    return chunks.withColumn("contextual", F.concat(head, F.coalesce(hint, F.lit("")), F.lit("\n"), F.col("document")))


def document_summary(chunks: Column, is_sheet: Column) -> Column:
    """The text that stands for a whole document: its first chunks, or a spread of them for a sheet; null if it says nothing new."""
    n = F.size(chunks)
    prose = F.array_join(F.slice(chunks, 1, 3), "\n\n").substr(1, 1500)
    step = F.greatest(F.expr("1"), F.floor(n / 8).cast("int"))
    spread = F.slice(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i % step) == 0), 1, 10)
    sheet = F.array_join(F.transform(spread, lambda i: F.get(chunks, i).substr(1, 200)), "\n\n").substr(1, 2000)
    summary = F.when(is_sheet & (n > 3), sheet).otherwise(prose)
    return F.when((n > 1) & (summary != F.get(chunks, F.lit(0))), summary)


def chunk_estimate(text: Column, name: Column) -> Column:
    """Chunks to expect of a text; 0 for a blank one."""
    divisor = F.when(F.lower(name).rlike(r"\.xlsx?$"), 420).otherwise(500)
    n = F.greatest(F.lit(1), F.floor(F.length(text) / divisor))
    return F.when(F.coalesce(stripped(text), F.lit("")) == "", F.lit(0)).otherwise(n).cast("bigint")


# --- scores and roles ---------------------------------------------------------------------------
def confidence(text: Column, terms: list[str] | None = None) -> Column:
    """Credibility of an extracted chunk from 0 to 1: script, length, noise and domain words. Lists of one bind the values that
    are used more than once."""
    plain = re.sub(r"([\\\]\[^-])", r"\\\1", PLAIN_MARKS)
    few = lambda t: F.size(F.filter(F.array(*map(F.lit, terms or DOMAIN_TERMS)), lambda w: t.contains(w)))

    def measures(t: Column) -> Column:
        lines = F.split(t, "\n")
        return F.struct(
            F.length(t).alias("n"), F.regexp_count(t, F.lit("[一-鿿]")).alias("cjk"), F.size(lines).alias("lines"),
            F.size(F.filter(lines, lambda line: F.length(F.trim(line)) == 1)).alias("lone"),
            F.regexp_count(t, F.lit(rf"[^\p{{L}}\p{{N}}{plain}]")).alias("noise"), few(t).alias("hits"),
        )

    def score(m: Column) -> Column:
        n, cjk = m["n"], m["cjk"] / m["n"]
        return (
            F.lit(50)
            + F.when(cjk > 0.4, 20).when(cjk > 0.2, 10).when((cjk < 0.05) & (n > 50), -20).otherwise(0)
            + F.when(n >= 200, 10).when(n < 50, -15).otherwise(0)
            - F.when(m["lone"] / m["lines"] > 0.3, 20).otherwise(0)
            - F.when(m["noise"] / n > 0.15, 15).otherwise(0)
            + F.when(m["hits"] >= 5, 20).when(m["hits"] >= 2, 10).otherwise(0)
        )

    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    bounded = lambda t: F.greatest(F.lit(0), F.least(F.lit(100), once(measures(t), score))) / 100
    return once(stripped(text), lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit(0.0)).otherwise(bounded(t)))


def semantic_role(text: Column) -> Column:
    """section_header, table, list_item or text_block."""
    t = stripped(text)
    lines = F.split(t, "\n")
    rows = F.size(F.filter(lines, lambda line: line.rlike(TABLE_ROW)))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "text_block")
        .when(t.rlike(HEADING), "section_header")
        .when((rows > 0) & (rows / F.size(lines) >= 0.4), "table")
        .when(t.rlike(LIST_ITEM), "list_item")
        .otherwise("text_block")
    )


def heading_level(text: Column) -> Column:
    """Level from the numbering at the beginning of a line; 0 for body text."""
    t = stripped(text)
    return (
        F.when(t.rlike(rf"^([{NUMERALS}]+、|第[{NUMERALS}]+章\s)"), 1)
        .when(t.rlike(r"^\d+\.\d+\.\d+\.\d+"), 4)
        .when(t.rlike(r"^\d+\.\d+\.\d+"), 3)
        .when(t.rlike(rf"^(\d+\.\d+|（[{NUMERALS}]+）)"), 2)
        .when(t.rlike(r"^\d+\.?\s+\S"), 1)
        .when(t.rlike(r"^第\d+节\s"), 2)
        .otherwise(0)
    )


def sections(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, section_no, title, level, content): a section begins at each heading; what comes before one is section 0."""
    w = Window.partitionBy(key).orderBy(order)
    level = heading_level(F.col(line))
    d = lines.withColumn("level", level).withColumn("section_no", F.sum((level > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(order, line)
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, at)))
    return d.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("level") > 0, F.regexp_replace(stripped(F.col(line)), r"\t\d*$", ""))).alias("title"),
        F.max("level").alias("level"),
        F.array_join(F.transform(body, lambda b: b[line]), "\n").alias("content"),
    )


def without_contents(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Lines without those of a table of contents: a title, then dots or a tab, then the number of a page."""
    return lines.filter(~F.coalesce(F.col(line), F.lit("")).rlike(r"^\s*\S.*?(\t|\.{3,}|…+|·{3,})\s*\d{1,4}\s*$"))


def first_sections(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections without later ones of an equal title, white space apart; sections without a title stay."""
    bare = F.regexp_replace("title", r"\s+", "")
    w = Window.partitionBy(key, bare).orderBy("section_no")
    return found.withColumn("__r", F.row_number().over(w)).filter("title is null or __r = 1").drop("__r")


def table_line_class(text: Column) -> Column:
    """text, reference, mixed or table, by the share of table lines among those that are not blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line) != "")
    rows = F.size(F.filter(lines, lambda line: F.trim(line).startswith("|")))
    return (
        F.when((rows == 0) & text.rlike(r"表\s*\d"), "reference")
        .when(rows == 0, "text")
        .when(rows / F.size(lines) < 0.6, "mixed")
        .otherwise("table")
    )


# --- cleaning and trimming ----------------------------------------------------------------------
def without_drawing_noise(text: Column) -> Column:
    """Lines of a few digits and marks, as drawings leave them, are dropped; units, CJK and tables stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~(F.trim(line).rlike(r"^[\d.+\-\s]{1,6}$"))), "\n")


def replaced(text: Column, typos: dict[str, str]) -> Column:
    for wrong, right in typos.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\w一-龥.\-]", "_"), "_{2,}", "_")


def revisions(text: Column) -> Column:
    """Array of (before, after) of marks of the form [修改前: A -> 修改后: B], also with the arrow's mark written -&gt;."""
    mark = F.lit(r"\[修改前:\s*(.*?)\s*-(?:>|&gt;)\s*修改后:\s*(.*?)\s*\]")
    return F.zip_with(F.regexp_extract_all(text, mark, 1), F.regexp_extract_all(text, mark, 2), lambda a, b: F.struct(a.alias("before"), b.alias("after")))


def without_thinking(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def json_body(text: Column) -> Column:
    """What is JSON in an answer: what its code fence holds, if there is one; from the first brace to the last, or the first
    bracket to the last, whichever begins first; null if there is neither."""
    t = without_thinking(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    t = F.when(fenced != "", fenced).otherwise(t)
    obj, arr = F.regexp_extract(t, r"(?s)\{.*\}", 0), F.regexp_extract(t, r"(?s)\[.*\]", 0)
    array_first = (arr != "") & ((obj == "") | (F.locate("[", t) < F.locate("{", t)))
    return F.when(array_first, arr).when(obj != "", obj)


def without_title(text: Column, title: Column) -> Column:
    """Without the title that generated text repeats at its beginning."""
    t = stripped(text)
    return F.when((title != "") & t.startswith(title), F.regexp_replace(t.substr(F.length(title) + 1, F.length(t)), r"^[\s:：]+", "")).otherwise(t)


def facts_limit(example: Column, is_list: Column, batch: bool) -> Column:
    """Characters of facts to pass on: few for lists, by the example's length interactively, a flat number in batch."""
    wide = F.lit(8000) if batch else F.greatest(F.lit(1000), F.least(F.length(example) * 5, F.lit(8000)))
    return F.when(is_list, 500).otherwise(wide)


def capped_segments(segments: Column, most: int = 10, glue: str = "\n\n") -> Column:
    """At most so many segments; the last takes the joined tail."""
    tail = F.array_join(F.slice(segments, most, 1 << 30), glue)
    return F.when(F.size(segments) <= most, segments).otherwise(F.concat(F.slice(segments, 1, most - 1), F.array(tail)))


def page_title(html: Column, otherwise: Column) -> Column:
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title).otherwise(otherwise)


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and navigation gone, tags dropped, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<head[^>]*>.*?</head>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def fenced_html(text: Column) -> Column:
    """The outermost HTML of an answer, out of its code fence if there is one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:html)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    whole = F.regexp_extract(body, r"(?is)<(?:!doctype|html|div|table|form).*>", 0)
    return F.when(whole != "", stripped(whole)).otherwise(stripped(body))


def form_title(html: Column) -> Column:
    heading = F.regexp_extract(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    return stripped(F.regexp_replace(F.when(heading != "", heading).otherwise(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), "<[^>]*>", ""))


def translated(term: Column, dictionary: dict[str, str]) -> Column:
    """A field's name with its meaning in brackets, where the dictionary knows it."""
    known = F.create_map(*[F.lit(x) for pair in dictionary.items() for x in pair]) if dictionary else F.create_map()
    meaning = known[F.upper(term)]
    return F.when(meaning.isNotNull(), F.concat(term, F.lit("("), meaning, F.lit(")"))).otherwise(term)


# Marks and phrases of the turns of a discussion between agents: the drafting expert, the arbiter, and what each says first.
DRAFTER, DRAFTING = r"(?:⚖️|\[段落起草专家\])", "正在起草章节初稿"
ARBITER, ARBITER_NAME, ARBITRATING = r"(?:👑|\[大BOSS\]|\[{}\])", "【协同】仲裁官", "(?:最终措辞润色|逻辑修正)"
LINE_END = r"(?:</p>|\n)\s*"


def final_part(text: Column, arbiter: str = ARBITER_NAME) -> Column:
    """The outcome of a discussion: what stands before the drafter's turn and, behind the arbiter's opening line, the final
    wording; the draft where the arbiter gave none (at most five characters); the text itself if nobody drafted."""
    boss = ARBITER.format(re.escape(arbiter))
    marks = r"(?:⚖️|\u2696|\uFE0F|\s|\*|<strong>|<p>|<hr\s*/?>)+$"
    head = stripped(F.regexp_replace(stripped(F.regexp_extract(text, rf"(?s)^(.*?){DRAFTER}", 1)), marks, ""))
    final = stripped(F.regexp_extract(text, rf"(?s){DRAFTER}.*?{boss}.*?{ARBITRATING}.*?{LINE_END}(.*)$", 1))
    draft = stripped(F.regexp_extract(text, rf"(?s){DRAFTER}.*?{DRAFTING}.*?{LINE_END}(.*)$", 1))
    draft = stripped(F.regexp_replace(draft, rf"(?s){boss}.*$", ""))
    glue = F.when(head == "", "").when(head.endswith(">"), "").otherwise("\n\n")
    long_enough = F.length(stripped(F.regexp_replace(final, "<[^>]*>", ""))) > 5
    return F.when(~text.rlike(f"(?s){DRAFTER}"), stripped(text)).when(long_enough, F.concat(head, glue, final)).when(draft != "", F.concat(head, glue, draft)).otherwise(stripped(text))


# The mark of a chart, and the kinds of charts.
CHART_MARK = r"\[可视化[：:]\s*(柱状图|饼图|雷达图)\s*[，,]\s*标题[：:]\s*(.+?)\s*\]"
CHART_KINDS = {"柱状图": "bar", "饼图": "pie", "雷达图": "radar"}


def charts(text: Column) -> Column:
    """Array of (kind, title, names, labels, series) of chart marks that a markdown table follows, blank lines between allowed:
    labels are its first column, and each other column is a series of numbers (units and thousands marks left out, null if none)."""
    from brindle.operators.tables import markdown_rows

    found = F.regexp_extract_all(text, F.lit(rf"{CHART_MARK}[^\n]*\n\s*((?:[ \t]*\|.*\|[ \t]*(?:\n|$))+)"), 0)
    kinds = F.create_map(*[F.lit(x) for pair in CHART_KINDS.items() for x in pair])
    number = lambda v: F.regexp_replace(v, r"[,\s元亩万%分]", "").try_cast("double")

    def chart(block: Column) -> Column:
        rows = F.filter(markdown_rows(block), lambda r: F.size(r) >= 2)

        def of(r: Column) -> Column:
            body, head = F.slice(r, 2, 1 << 30), F.get(r, F.lit(0))
            series = F.transform(F.sequence(F.lit(1), F.greatest(F.size(head) - 1, F.lit(1))), lambda c: F.transform(body, lambda x: number(F.get(x, c))))
            return F.struct(
                kinds[F.regexp_extract(block, CHART_MARK, 1)].alias("kind"), F.regexp_extract(block, CHART_MARK, 2).alias("title"),
                F.slice(head, 2, 1 << 30).alias("names"), F.transform(body, lambda x: F.get(x, F.lit(0))).alias("labels"), series.alias("series"),
            )

        return F.element_at(F.transform(F.array(rows), of), 1)

    return F.filter(F.transform(found, chart), lambda c: F.size(c["labels"]) > 0)


# Marks of citations (titles, numbers of standards, numbers of documents) and words of chapters of policy.
CITATION = r"《.+?》|[（(][A-Z]{1,4}[/T]?\d|〔\d{4}〕|GB[/T]|DB\d|SL[/T]|JTG"
POLICY_WORDS = "背景 依据 概述 概况 前言 总论 综述 必要性 可行性 意义 目的 政策 技术路线 方法 思路 指导思想 编制依据".split()


def is_citation_list(text: Column, long: int = 80, most_long: int = 2) -> Column:
    """True if over half the lines hold a citation mark and hardly any is long."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda line: line != "")
    cited = F.size(F.filter(lines, lambda line: line.rlike(CITATION)))
    return (F.size(lines) > 0) & (cited * 2 > F.size(lines)) & (F.size(F.filter(lines, lambda line: F.length(line) > long)) <= most_long)


def is_policy_title(title: Column) -> Column:
    """True for titles of chapters of policy and background, which may be written more freely."""
    return title.rlike("|".join(POLICY_WORDS))


# The mark of a chunk that describes a figure, and words of those that say something of the project all the same.
FIGURE_MARK = "[图件解析]"
FIGURE_KEPT = "建设地点 行政村 建设规模 工程概况 编制说明 项目概况 设计依据 建设范围 项目名称".split()


def is_figure_note(text: Column) -> Column:
    """Chunks that only describe a figure, without saying anything of the project."""
    return F.ltrim(text).startswith(FIGURE_MARK) & ~text.rlike("|".join(FIGURE_KEPT))


# Suffixes of places, words that only look like places, and phrases that say nothing.
PLACE = "[一-龥]{2,5}(?:省|市|县|区|镇|乡|村|街道)"
NO_PLACES = "工业区 保护区 流域区 开发区 风景区 示范区 居住区 规划区 核心区 缓冲区 实验区 控制区 灌溉区 超采区 补给区 排泄区 径流区".split()
NO_THEMES = (
    "是保障 是落实 是推动 的重要 等工程 等措施 可显著 的目标 的任务 的政策 的决策 的规划 提出了 印发了 明确了 强调要 着力于 聚焦于 "
    "为乡村 为粮食 根据中 关于加 关于高 全面落 主要为 主要有 主要包 通过土 通过工 确保到 部门联 部门人 建设的 建成高 建设规"
).split()
FIGURES = r"\d[\d.]*\s*(?:年|亿|万|亩|元|%|米|公里|公顷|吨|人|户|个|条|座|处)?"


def place_names(text: Column) -> Column:
    """Every mention of a place in a text, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(PLACE), 0), lambda p: ~p.isin(NO_PLACES))


def theme_phrases(text: Column, head: int | None = 800) -> Column:
    """Phrases of three to eight characters of the head of an example (all of it, if None), in order: without places, figures, titles and what is in brackets."""
    t = text if head is None else text.substr(1, head)
    t = F.regexp_replace(F.regexp_replace(t, PLACE, ""), FIGURES, "")
    t = F.regexp_replace(F.regexp_replace(t, "[（(][^)）]*[)）]", ""), "《[^》]*》", "")
    clauses = F.filter(F.split(t, "[，。！？；、\\n]+"), lambda c: F.length(F.trim(c)) >= 2)
    found = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit("[一-龥]{2,8}"), 0)))
    return F.filter(found, lambda p: (F.length(p) >= 3) & ~p.isin(NO_THEMES))


def most_frequent(terms: DataFrame, by: str, term: str = "term", most: int = 15) -> DataFrame:
    """(by, term, n, place) of the most frequent terms of each group, the earliest (column `at`) of equals first: a top-k report."""
    g = terms.groupBy(by, term).agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "at", term)
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= most).select(by, term, "n", "place")


# Titles of tables in an example.
EXAMPLE_TABLE = r"([续附]?表[\d\-.]*\s*[^\n|]{2,60}(?:表|统计|汇总|一览|分析|情况|清单|数据|成果|明细|计算|对比|参数|方案))"
LONGEST_TABLE, CUT_NOTE = 10_000, "\n...[表格过长，已截断]"


def example_tables(text: Column) -> Column:
    """Array of (name, title_line, first, last) of tables under a title: blank lines may lie between title and table, nothing else.
    Lines count from 0; a table's lines follow each other."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    kinds = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.when(line.startswith("|"), "t").when(line == "", "b").otherwise("x").alias("k")))
    solid = F.filter(kinds, lambda e: e["k"] != "b")  # what is left follows a title directly
    at = lambda a, i: F.get(a, i)

    def tables(s: Column) -> Column:
        # A table begins where a bar line follows a line of text; it ends where the next line of the text is no bar line.
        begins = F.filter(F.transform(s, lambda e, j: F.struct(e.alias("e"), at(s, j - 1).alias("b"))), lambda p: (p["e"]["k"] == "t") & (F.coalesce(p["b"]["k"], F.lit("")) == "x") & p["b"]["line"].rlike(EXAMPLE_TABLE))
        ends = F.filter(kinds, lambda e: (e["k"] == "t") & (F.coalesce(at(kinds, e["i"] + 1)["k"], F.lit("x")) != "t"))
        return F.transform(
            begins,
            lambda p: F.struct(
                F.trim(F.regexp_extract(p["b"]["line"], EXAMPLE_TABLE, 1)).alias("name"), p["b"]["i"].alias("title_line"), p["e"]["i"].alias("first"),
                F.array_min(F.transform(F.filter(ends, lambda e: e["i"] >= p["e"]["i"]), lambda e: e["i"])).alias("last"),
            ),
        )

    return F.element_at(F.transform(F.array(solid), tables), 1)


def tables_replaced(text: Column, tables: Column, bodies: Column) -> Column:
    """An example with the bodies of its tables (from example_tables) replaced by those of a map from name to markdown; what has
    none stays. Each line is kept, dropped or replaced, so no place moves while others are filled in."""
    cut = lambda md: F.when(F.length(md) > LONGEST_TABLE, F.concat(md.substr(1, LONGEST_TABLE), F.lit(CUT_NOTE))).otherwise(md)
    known = F.filter(F.transform(tables, lambda t: F.struct(t["first"].alias("first"), t["last"].alias("last"), bodies[t["name"]].alias("md"))), lambda t: F.coalesce(t["md"], F.lit("")) != "")

    def line(value: Column, i: Column) -> Column:
        inside = F.get(F.filter(known, lambda t: i.between(t["first"], t["last"])), F.lit(0))
        return F.when(inside.isNull(), value).when(i == inside["first"], cut(inside["md"]))

    return F.array_join(F.array_compact(F.transform(F.split(text, "\n"), line)), "\n")
