"""Cases for rules of Chinese text, sheets, model answers and jobs: small literal tables, with the vocabulary and thresholds that
the operators ship with, and the rows that the rules give, worked out by hand. They are tests, not queries: nothing here reads a
given table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import nlp as N
from brindle.functions import text as X
from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.operators import search as S
from brindle.operators import tables as T
from brindle.sources import readers
from brindle.streaming import monitors as M


CASES, EXPECTED = {}, {}


def query(name: str, oracle: str):
    """Register a case under a name, with the rows that it gives as SQL."""

    def add(function):
        CASES[name], EXPECTED[name] = function, oracle
        return function

    return add


def spark_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(map(spark_literal, v)) + ")"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def literal(spark, names: str, rows: list[tuple]):
    """A table of a few rows, as Spark's VALUES."""
    body = ", ".join("(" + ", ".join(map(spark_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names.split())})")


def expected(names: str, rows: list[tuple]) -> str:
    """The rows as DuckDB's VALUES. Whole numbers are BIGINT, others DOUBLE."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{v}::BIGINT"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(chr(34) + n + chr(34) for n in names.split())})"


def joined(array, glue: str = "|"):
    return F.array_join(array, glue)


# --- language -----------------------------------------------------------------------------------
QUESTIONS = [(1, "一共有多少个"), (2, "最大的是哪一个"), (3, "大坝造价"), (4, "对比两个方案"), (5, "总结项目"), (6, "涉及哪些单位"), (7, "有什么风险"), (8, "你好")]


@query("intent_words", expected("id intent vector_top_k inject_data_analysis", [
    (1, "data_analysis", 2, True), (2, "table_stats", 4, False), (3, "data_lookup", 6, False), (4, "comparison", 8, False), (5, "summary", 8, False),
    (6, "graph_focus", 8, False), (7, "risk_analysis", 8, False), (8, "general_qa", 8, False)]))
def intent_words(spark, sf_dir):
    """Intents by the words as shipped, and their plans; one without a plan has that of general questions."""
    q = literal(spark, "id text", QUESTIONS).withColumn("intent", N.intent(F.col("text")))
    none = F.lit(0.0)
    d = N.with_plan(q, N.plans(spark), none, none, none)
    return d.select(F.col("id").cast("bigint").alias("id"), "intent", F.col("vector_top_k").cast("bigint").alias("vector_top_k"), "inject_data_analysis")


@query("entities_of_questions", expected("id names", [(1, "整治地块 12#|整治地块|的灌溉面积"), (2, "青山水库大坝"), (3, ""), (4, "开发复垦3|开发复垦")]))
def entities_of_questions(spark, sf_dir):
    q = literal(spark, "id text", [(1, "整治地块 12#的灌溉面积"), (2, "青山水库大坝 是什么"), (3, "hi"), (4, "开发复垦3")])
    return q.select(F.col("id").cast("bigint").alias("id"), joined(N.query_entities(F.col("text"))).alias("names"))


@query("simple_messages", expected("id simple", [(1, True), (2, True), (3, False), (4, False)]))
def simple_messages(spark, sf_dir):
    q = literal(spark, "id text", [(1, "你好！"), (2, "请问你是谁"), (3, "水库的水位是多少"), (4, "x" * 41)])
    return q.select(F.col("id").cast("bigint").alias("id"), N.is_simple(F.col("text")).alias("simple"))


@query("pointed_back", expected("id resolved", [(1, "这个多少 青山水库 总库容 万元 120万元"), (2, "水位多少")]))
def pointed_back(spark, sf_dir):
    q = literal(spark, "id text reply", [(1, "这个多少", "青山水库，总库容，120万元"), (2, "水位多少", "青山水库")])
    return q.select(F.col("id").cast("bigint").alias("id"), N.resolved(F.col("text"), F.col("reply")).alias("resolved"))


@query("form_fields_shipped", expected("id fields", [(1, "penalty_type|fine_amount_yuan|legal_basis"), (2, "company_name"), (3, "")]))
def form_fields_shipped(spark, sf_dir):
    d = literal(spark, "id text", [(1, "罚款依据"), (2, "当事人：青山有限公司"), (3, "无")])
    return d.select(F.col("id").cast("bigint").alias("id"), joined(N.form_fields(F.col("text"))).alias("fields"))


RECORD = '{"company_name":"a","credit_code":"%s","penalty_type":"%s","legal_basis":"x"%s}'


@query("penalty_records", expected("id valid fine", [(1, True, 0.0), (2, False, 5.5), (3, False, 0.0), (4, False, None)]))
def penalty_records(spark, sf_dir):
    d = literal(spark, "id text", [(1, RECORD % ("91330000MA27XXXX12", "罚款", "")), (2, RECORD % ("short", "警告", ',"fine_amount_yuan":5.5')), (3, RECORD % ("91330000MA27XXXX12", "other", "")), (4, "no json")])
    record, ok = N.valid_record(F.col("text"))
    fine = F.when(F.col("text").startswith("{"), record["fine_amount_yuan"])
    return d.select(F.col("id").cast("bigint").alias("id"), ok.alias("valid"), fine.alias("fine"))


@query("slot_answers", expected("id filled", [(1, "新县有新村"), (2, "旧县有旧村"), (3, "新县有旧村"), (4, "旧县有旧村")]))
def slot_answers(spark, sf_dir):
    answers = [
        (1, '<think>{"x"}</think>```json\n{"slots": [{"old": "旧县", "new": "新县", "type": "地名"}, {"old": " 旧村 ", "new": "新村"}]}\n```'),
        (2, "no answer"),
        (3, 'so: {"slots": [{"old": "旧县", "new": "新县"}, {"old": "", "new": "x"}, {"old": "旧村"}]} done'),
        (4, '{"slots": "none"}'),
    ]
    return literal(spark, "id text", answers).select(F.col("id").cast("bigint").alias("id"), N.filled(F.lit("旧县有旧村"), N.slots(F.col("text"))).alias("filled"))


@query("form_words", expected("id words question", [(1, "项目 名称|面积|建设单位", "项目 名称 面积 建设单位"), (2, "", "表格填写背景资料与事实信息")]))
def form_words(spark, sf_dir):
    html = "<table><tr><td>项目__名称</td><TH class='x'><b>面积</b></TH><td>是</td><td>面积</td></tr></table><p>建设单位：____</p><span>" + "长" * 20 + "：x</span><p>no colon</p>"
    d = literal(spark, "id html", [(1, html), (2, "<p>none</p>")]).withColumn("w", N.table_words(F.col("html")))
    return d.select(F.col("id").cast("bigint").alias("id"), joined("w").alias("words"), N.form_question(F.col("w")).alias("question"))


@query("codes_of_cells", expected("id codes", [(1, "K12+300|A7x9|3+5.5|DN-200"), (2, "")]))
def codes_of_cells(spark, sf_dir):
    d = literal(spark, "id cells", [(1, ["桩号 K12+300", "A7x9", "a1", "3+5.5 和 DN-200", "A7x9"]), (2, ["1234", "abcd", "x"])])
    return d.select(F.col("id").cast("bigint").alias("id"), joined(N.cell_codes(F.col("cells"))).alias("codes"))


@query("judge_lists", expected("id documents", [(1, "a|b"), (2, "plain text"), (3, "[broken")]))
def judge_lists(spark, sf_dir):
    d = literal(spark, "id text", [(1, '["a", "b"]'), (2, "plain text"), (3, "[broken")])
    return d.select(F.col("id").cast("bigint").alias("id"), joined(N.judged_documents(F.col("text"))).alias("documents"))


@query("instants", expected("id utc local", [(1, "2026-01-02 03:04:05", "2026-01-02 11:04:05"), (2, "2026-01-01 19:04:05", "2026-01-02 03:04:05"), (3, None, None)]))
def instants(spark, sf_dir):
    d = literal(spark, "id text", [(1, "2026-01-02T03:04:05Z"), (2, "2026-01-02T03:04:05+08:00"), (3, "soon")]).withColumn("at", N.instant(F.col("text")))
    utc = F.to_utc_timestamp("at", F.current_timezone())
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return d.select(F.col("id").cast("bigint").alias("id"), show(utc).alias("utc"), show(N.in_zone(F.col("at"))).alias("local"))


# --- text ---------------------------------------------------------------------------------------
LONG = "本段说明混凝土保护层与钢筋的施工要求，排水边坡的坡度按照图例执行。" * 7


@query("confidence_of_terms", expected("id confidence", [(1, 1.0), (2, 0.55), (3, 0.15), (4, 0.0)]))
def confidence_of_terms(spark, sf_dir):
    """1: script, length and terms; 2: script but short; 3: Latin noise of some length, no script; 4: blank."""
    d = literal(spark, "id text", [(1, LONG), (2, "短句"), (3, "#@~" * 20), (4, " \n")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.confidence(F.col("text")).alias("confidence"))


@query("role_of_chunks", expected("id role", [(1, "table"), (2, "text_block"), (3, "section_header"), (4, "list_item")]))
def role_of_chunks(spark, sf_dir):
    """Tables from two rows of five lines on."""
    d = literal(spark, "id text", [(1, "a\nb\nc\n| x | y |\n| 1 | 2 |"), (2, "a\nb\nc\nd\n| x | y |"), (3, "第三章 总则\n内容"), (4, "- 第一项")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.semantic_role(F.col("text")).alias("role"))


@query("drawing_noise", expected("id text", [(1, "坝高 30 m\n| 1 | 2 |\n备注"), (2, "1234567")]))
def drawing_noise(spark, sf_dir):
    d = literal(spark, "id text", [(1, "12.5\n坝高 30 m\n+ 3\n| 1 | 2 |\n- 4.\n备注"), (2, "1234567")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.without_drawing_noise(F.col("text")).alias("text"))


@query("spellings", expected("id text name term", [(1, "地形图与田型", "a_b_图.txt", "DLMC(地类名称)"), (2, "x", "_.md", "other")]))
def spellings(spark, sf_dir):
    d = literal(spark, "id text name term", [(1, "地型图与田形", "a  b?/图.txt", "DLMC"), (2, "x", "**.md", "other")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.replaced(F.col("text"), S.TYPOS).alias("text"), X.safe_name(F.col("name")).alias("name"), X.translated(F.col("term"), {"DLMC": "地类名称"}).alias("term"))


@query("revision_marks", expected("id marks", [(1, "旧>新|甲>乙"), (2, "")]))
def revision_marks(spark, sf_dir):
    d = literal(spark, "id text", [(1, "x[修改前:旧 -> 修改后: 新]y[修改前: 甲 -&gt; 修改后:乙 ]"), (2, "none")])
    return d.select(F.col("id").cast("bigint").alias("id"), joined(F.transform(X.revisions(F.col("text")), lambda r: F.concat(r["before"], F.lit(">"), r["after"]))).alias("marks"))


TABLE = "| 名称 | 面积 | 投资 |\n| --- | --- | --- |\n| 甲 | 1,200亩 | 3 |\n| 乙 | 无 | 4万元 |"


@query("chart_marks", expected("id kind title names labels series", [(1, "bar", "面积", "面积|投资", "甲|乙", "1200.0,null|3.0,4.0"), (2, "pie", "x", "v", "a", "5.0")]))
def chart_marks(spark, sf_dir):
    d = literal(spark, "id text", [(1, f"前\n[可视化：柱状图，标题：面积]\n\n{TABLE}\n后"), (2, "[可视化:饼图,标题:x]\n| n | v |\n| a | 5% |"), (3, "[可视化：雷达图，标题：y]\nno table"), (4, f"[可视化：其他，标题：z]\n{TABLE}")])
    d = d.select("id", F.explode(X.charts(F.col("text"))).alias("c"))
    number = lambda v: F.coalesce(v.cast("string"), F.lit("null"))
    series = joined(F.transform("c.series", lambda s: joined(F.transform(s, number), ",")))
    return d.select(F.col("id").cast("bigint").alias("id"), "c.kind", "c.title", joined("c.names").alias("names"), joined("c.labels").alias("labels"), series.alias("series"))


@query("discussion_outcome", expected("id text", [(1, "题目\n\n定稿的全部内容"), (2, "题目\n\n初稿的内容"), (3, "没有讨论")]))
def discussion_outcome(spark, sf_dir):
    draft = "题目\n⚖️ [段落起草专家] 正在起草章节初稿\n初稿的内容\n"
    d = literal(spark, "id text", [(1, draft + "👑 [大BOSS] 最终措辞润色\n定稿的全部内容"), (2, draft + "👑 [大BOSS] 最终措辞润色\n短"), (3, " 没有讨论 ")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.final_part(F.col("text")).alias("text"))


@query("json_of_answers", expected("id body", [(1, '{"a": 1}'), (2, '[{"b": 2}]'), (3, '{"c": [3]}'), (4, None)]))
def json_of_answers(spark, sf_dir):
    d = literal(spark, "id text", [(1, 'x <think>{"no"}</think> {"a": 1} y'), (2, '```json\n[{"b": 2}]\n```'), (3, 'so {"c": [3]}.'), (4, "none")])
    return d.select(F.col("id").cast("bigint").alias("id"), X.json_body(F.col("text")).alias("body"))


@query("citation_lists", expected("id listed policy figure", [(1, True, True, False), (2, False, False, True), (3, False, False, False)]))
def citation_lists(spark, sf_dir):
    rows = [(1, "《水法》\nGB/T 50265\n其他", "编制依据", "[图件解析] 建设地点：青山镇"), (2, "叙述\n《水法》", "工程量", " [图件解析] 图例"), (3, "", "附表", "坝高 30 m")]
    d = literal(spark, "id text title note", rows)
    return d.select(F.col("id").cast("bigint").alias("id"), X.is_citation_list(F.col("text")).alias("listed"), X.is_policy_title(F.col("title")).alias("policy"), X.is_figure_note(F.col("note")).alias("figure"))


@query("places_and_themes", expected("kind term n place", [("place", "青山县", 2, 1), ("place", "清水镇", 1, 2), ("theme", "高标准农田建设", 2, 1), ("theme", "灌溉渠道", 1, 2)]))
def places_and_themes(spark, sf_dir):
    text = "青山县，高标准农田建设。青山县，（2020年）高标准农田建设；清水镇，灌溉渠道，保护区"
    d = literal(spark, "id text", [(1, text)])
    rows = lambda kind, c: d.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("at", "term"))
    # 保护区 is no place; as it stands alone it is a phrase that themes leave out by their pattern of places.
    terms = rows("place", X.place_names(F.col("text"))).unionByName(rows("theme", X.theme_phrases(F.col("text"))))
    return X.most_frequent(terms, "kind")


EXAMPLE = "前言\n表1-1 土地面积统计表\n\n| 名 | 值 |\n| --- | --- |\n| a | 1 |\n正文\n表2 其他情况\n文字\n| x |"


@query("example_tables_replaced", expected("id names text", [(1, "表1-1 土地面积统计表@3-5", "前言\n表1-1 土地面积统计表\n\n| new |\n正文\n表2 其他情况\n文字\n| x |"), (2, "", "none")]))
def example_tables_replaced(spark, sf_dir):
    d = literal(spark, "id text", [(1, EXAMPLE), (2, "none")]).withColumn("t", X.example_tables(F.col("text")))
    names = joined(F.transform("t", lambda t: F.concat(t["name"], F.lit("@"), t["first"].cast("string"), F.lit("-"), t["last"].cast("string"))))
    bodies = F.create_map(F.lit("表1-1 土地面积统计表"), F.lit("| new |"))
    return d.select(F.col("id").cast("bigint").alias("id"), names.alias("names"), X.tables_replaced(F.col("text"), F.col("t"), bodies).alias("text"))


@query("sections_of_lines", expected("section_no title content", [(0, None, "封面"), (1, "1.1 总则", "正文一"), (2, "2.1 范围", "")]))
def sections_of_lines(spark, sf_dir):
    """Contents pages are left out, and so is a later section of an equal title."""
    rows = [(1, 0, "封面"), (1, 1, "1.1 总则........3"), (1, 2, "2.1 范围\t4"), (1, 3, "1.1 总则"), (1, 4, "正文一"), (1, 5, "2.1 范围"), (1, 6, "1.1  总则"), (1, 7, "again")]
    s = X.first_sections(X.sections(X.without_contents(literal(spark, "doc_id line_no line", rows))))
    return s.select(F.col("section_no").cast("bigint").alias("section_no"), "title", "content")


# --- tables -------------------------------------------------------------------------------------
SHEET = [
    ["青山县统计表", "青山县统计表", "青山县统计表", ""],
    ["单位：亩", "", "", ""],
    ["名称", "面积", "面积", ""],
    ["名称", "耕地", "林地", ""],
    ["甲", "1", "nan", ""],
    ["", "2", "3", ""],
    ["None", "", "", ""],
]
PLAIN = [["", ""], ["x", "y"], ["p", "1"], ["q", "2"]]


def matrices(spark):
    rows = [("t", r, c, v) for r, row in enumerate(SHEET) for c, v in enumerate(row)] + [("u", r, c, v) for r, row in enumerate(PLAIN) for c, v in enumerate(row)]
    cells = literal(spark, "table_id r c value", rows)
    ranges = literal(spark, "table_id r0 c0 r1 c1", [("t", 4, 0, 5, 0), ("t", 0, 0, 0, 2)])
    g = cells.groupBy("table_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "value"))), lambda x: x["value"]).alias("row"))
    g = g.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("rows"))
    return T.rows_of(T.merged_filled(T.trimmed(T.cells_of(g)), ranges)), ranges


@query("sheet_headers", expected("table_id headers unit title first merged", [("t", "名称|面积_耕地|面积_林地", "单位：亩", "青山县统计表", 4, "名称"), ("u", "x|y", "", "", 2, None)]))
def sheet_headers(spark, sf_dir):
    rows, ranges = matrices(spark)
    h = T.with_headers(rows)
    d = h.join(T.merged_names(h, ranges), "table_id", "left")
    return d.select("table_id", joined("headers").alias("headers"), "unit", "title", F.col("first").cast("bigint").alias("first"), joined("names").alias("merged"))


@query("sheet_rows", expected("table_id r text markdown", [
    ("t", 4, "名称: 甲 | 面积_耕地: 1", "| 甲 | 1 |  |"), ("t", 5, "名称: 甲 | 面积_耕地: 2 | 面积_林地: 3", "| 甲 | 2 | 3 |"), ("u", 2, "x: p | y: 1", "| p | 1 |"), ("u", 3, "x: q | y: 2", "| q | 2 |")]))
def sheet_rows(spark, sf_dir):
    rows, _ = matrices(spark)
    h = T.with_headers(rows)
    d = T.data_rows(rows, h).join(h.select("table_id", "headers"), "table_id")
    md = F.element_at(F.split(T.markdown_of(F.col("headers"), F.array("row")), "\n"), 3)
    return d.select("table_id", F.col("r").cast("bigint").alias("r"), T.row_text(F.col("headers"), F.col("row")).alias("text"), md.alias("markdown"))


@query("layout_tables", expected("id false_table squeezed rows", [(1, True, "a|b|", 2), (2, False, "a|", 3), (3, True, "x||", 2), (4, True, "", 1)]))
def layout_tables(spark, sf_dir):
    """1: prose in a cell; 2: a table; 3: one filled column; 4: a single row."""
    md = [(1, ["a", "a", "b"], 3, "| 一二三四五六七八九十一二三四五六七八九十，更多 | x |\n| 1 | 2 |"), (2, ["a", "a"], 2, "| n | v |\n|---|---|\n| a | 1 |\n| b | 2 |"), (3, ["x"], 3, "| n |  |\n| a |  |"), (4, [""], 1, "| a | b |")]
    d = literal(spark, "id cells width md", md)
    rows = T.markdown_rows(F.col("md"))
    return d.select(F.col("id").cast("bigint").alias("id"), T.is_false_table(rows).alias("false_table"), joined(T.without_neighbour_repeats(F.col("cells"), F.col("width"))).alias("squeezed"), F.size(rows).cast("bigint").alias("rows"))


@query("row_classes", expected("id class", [(1, "total"), (2, "rule"), (3, "index"), (4, "note"), (5, "data"), (6, "empty")]))
def row_classes(spark, sf_dir):
    rows = [(1, ["", "合计", "3"]), (2, ["---", ":-:"]), (3, ["（1）", "(2)"]), (4, ["注：x", "1"]), (5, ["合计数", "1"]), (6, ["", " "])]
    return literal(spark, "id cells", rows).select(F.col("id").cast("bigint").alias("id"), R.row_class(F.col("cells")).alias("class"))


@query("profile_with_totals", expected("column n total stated_total mean", [("v", 3, 7.0, 7.0, 2.0), ("w", 2, 3.0, None, 1.5)]))
def profile_with_totals(spark, sf_dir):
    """A total row is no value; what it states wins over the sum (6 here), and where it states nothing the sum stays."""
    d = literal(spark, "k v w", [("a", "1", "1"), ("b", "2", "2"), ("c", "3", "—"), ("合计", "7", "-")])
    p = R.profile_numeric(d, ["v", "w"], stated=R.is_total_row(F.col("k")))
    return p.select("column", "n", "total", "stated_total", "mean")


@query("business_columns", expected("kind column n total value", [("number", "TBMJ", 3, 30001.5, None), ("text", "DLMC", 2, None, "旱地"), ("text", "DLMC", 1, None, "水田")]))
def business_columns(spark, sf_dir):
    d = literal(spark, "OBJECTID BSM DLMC TBMJ", [(1, "k1", "旱地", 10000.5), (2, "k2", "旱地", 20000.0), (3, "k3", "水田", 1.0)])
    words = ("面积", "MJ", "AREA", "LENGTH", "长度", "周长", "金额", "数量", "宽度", "高程", "坡度")
    numeric, texts = R.business_profile(d, words)
    a = numeric.select(F.lit("number").alias("kind"), "column", "n", "total", F.lit(None).cast("string").alias("value"))
    return a.unionByName(texts.select(F.lit("text").alias("kind"), "column", "n", F.lit(None).cast("double").alias("total"), "value"))


@query("area_by_class", expected("category value total n shown", [
    ("DLMC", "旱地", 30000.5, 2, "30000.50 (约 3.00 公顷 / 45.00 亩)"), ("DLMC", "水田", 1.0, 1, "1.00"), ("权属", "集体", 20001.0, 2, "20001.00 (约 2.00 公顷 / 30.00 亩)"), ("权属", "国有", 10000.5, 1, "10000.50 (约 1.00 公顷 / 15.00 亩)")]))
def area_by_class(spark, sf_dir):
    """Categories and measure found by their names; each category on its own; large areas with their units."""
    return R.auto_summary(literal(spark, "id DLMC `权属` TBMJ other", [(1, "旱地", "国有", 10000.5, "a"), (2, "旱地", "集体", 20000.0, "b"), (3, "水田", "集体", 1.0, "c")]))


@query("titles_by_core", expected("id core", [(1, "主要农产品年产量统计表"), (2, "主要农产品年产量统计表"), (3, "耕地质量")]))
def titles_by_core(spark, sf_dir):
    rows = [(1, "续表5-11 青山县主要农产品年产量统计表"), (2, "表19 （社区）主要农产品年产量统计表"), (3, "附表 清水镇耕地 质量（亩）")]
    return literal(spark, "id title", rows).select(F.col("id").cast("bigint").alias("id"), T.title_core(F.col("title")).alias("core"))


@query("titles_matched", expected("project_id wanted_id have_id ratio", [("p", 1, 10, 1.0)]))
def titles_matched(spark, sf_dir):
    """In order; a table goes once, and cores of two characters match nothing."""
    a = literal(spark, "project_id wanted_id title", [("p", 1, "表1 青山县土地面积统计"), ("p", 2, "表2 土地面积统计"), ("p", 3, "表3 合计")])
    b = literal(spark, "project_id have_id title", [("p", 10, "土地面积统计"), ("p", 11, "合计")])
    d = T.matched_titles(a, b)
    return d.select("project_id", F.col("wanted_id").cast("bigint").alias("wanted_id"), F.col("have_id").cast("bigint").alias("have_id"), "ratio")


@query("titles_with_fallbacks", expected("wanted_id have_id by", [(1, 10, "pairs"), (2, 11, "place"), (3, 12, "characters")]))
def titles_with_fallbacks(spark, sf_dir):
    a = literal(spark, "wanted_id place title", [(1, 0, "土地面积"), (2, 1, "没有"), (3, 9, "甲乙丙丁")])
    b = literal(spark, "have_id place title", [(10, 5, "面积与土地"), (11, 1, "其他"), (12, 7, "丁丙乙"), (13, 8, "甲x乙")])
    return R.titles_for(a, b).select(F.col("wanted_id").cast("bigint").alias("wanted_id"), F.col("have_id").cast("bigint").alias("have_id"), "by")


@query("first_table_with_rows", expected("name total", [("second", 7.0)]))
def first_table_with_rows(spark, sf_dir):
    one = literal(spark, "id b v", [("地块001", 1, 5.0)])
    two = literal(spark, "id b v", [("地块007", 1, 3.0), ("地块007", 1, 3.0), ("地块007", 2, 4.0), ("合计", 3, 99.0)])
    name, total = T.first_answer([("first", one), ("second", two)], "id", ["007", "7"], [], "v", "b")
    return total.select(F.lit(name).alias("name"), "total")


@query("heads_of_sheets", expected("sheet n last columns", [("a", 15, 14, "sheet|r|c0|c1|c2|c3|c4|c5|c6|c7"), ("b", 2, 1, "sheet|r|c0|c1|c2|c3|c4|c5|c6|c7")]))
def heads_of_sheets(spark, sf_dir):
    rows = [(s, r, *range(10)) for s, n in (("a", 40), ("b", 2)) for r in range(n)]
    d = R.head_rows(literal(spark, "sheet r " + " ".join(f"c{k}" for k in range(10)), rows), "sheet", "r")
    return d.groupBy("sheet").agg(F.count("*").alias("n"), F.max("r").cast("bigint").alias("last"), F.first(F.lit("|".join(d.columns))).alias("columns"))


# --- search -------------------------------------------------------------------------------------
@query("sparse_weights", expected("query_id key score rank0", [(1, 10, 2.5, 0), (1, 11, 0.5, 1), (2, 12, 0.01, 0)]))
def sparse_weights(spark, sf_dir):
    """Given weights: the greatest of a token counts, special tokens and weights of zero do not, and a text without any has one entry."""
    tokens = literal(spark, "key token weight", [(10, 5, 1.0), (10, 5, 2.0), (10, 6, 0.5), (10, 0, 9.0), (11, 6, 0.5), (11, 7, 0.0), (12, 2, 3.0)])
    asked = literal(spark, "query_id token weight", [(1, 5, 1.0), (1, 6, 1.0), (2, 1, 1.0)])
    d = S.sparse_dot(asked, S.sparse_vectors(tokens), 10)
    return d.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("key").cast("bigint").alias("key"), "score", "rank0")


@query("parameters_first", expected("query_id doc_id place", [(1, 2, 0), (1, 1, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2)]))
def parameters_first(spark, sf_dir):
    """A question for figures takes passages with a figure and its own word of parameters first; another question none."""
    texts = {1: "概况", 2: "坝顶高程 120.5 m", 3: "投资 300 万元"}
    rows = [(q, d, d - 1, t, texts[d]) for q, t in ((1, "高程是多少"), (2, "介绍项目")) for d in texts]
    h = literal(spark, "query_id doc_id rank0 question document", rows)
    hit = S.asks_for_data(F.col("question")) & S.holds_parameter(F.col("question"), F.col("document"))
    d = S.boosted_first(h, hit)
    return d.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("place").cast("bigint").alias("place"))


@query("context_of_projects", expected("project_id context", [("p", "[来源: a.txt]\nA\n\n[来源: 未知]\nC")]))
def context_of_projects(spark, sf_dir):
    """Equal chunks once, the first three rows of each question, the best by score."""
    rows = [("p", 0, 0, 1, 0, 0.9, "A", "a.txt"), ("p", 1, 0, 1, 0, 0.99, "A", "a.txt"), ("p", 1, 1, 2, 0, 0.5, "C", None), ("p", 1, 3, 3, 0, 1.0, "late", "b.txt")]
    return S.global_context(literal(spark, "project_id question_no rank0 doc_id chunk_index score document filename", rows))


@query("project_questions", expected("project_id n first", [("p", 3, "青山 面积 价格 数据 统计 区片"), ("q", 3, "面积 价格 数据 统计 区片")]))
def project_questions(spark, sf_dir):
    d = S.global_questions(literal(spark, "project_id name", [("p", "青山"), ("q", None)]))
    return d.groupBy("project_id").agg(F.count("*").alias("n"), F.min_by("text", "question_no").alias("first"))


# --- graphs -------------------------------------------------------------------------------------
CHAIN = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "s", "c")]


@query("document_trees", expected("src relation dst", [("1", "HAS_ELEMENT", "1#0"), ("1", "HAS_ELEMENT", "1#1"), ("penalty_type", "EVIDENCE_BY", "1#0"), ("fine_amount_yuan", "EVIDENCE_BY", "1#0"), ("legal_basis", "EVIDENCE_BY", "1#0")]))
def document_trees(spark, sf_dir):
    return G.document_tree(literal(spark, "doc_id chunk_index document", [(1, 0, "罚款"), (1, 1, "x")]), N.form_fields(F.col("document")))


@query("ranked_paths", expected("seed node distance rank0", [("a", "d", 2, 0), ("a", "c", 1, 1), ("a", "c", 2, 2)]))
def ranked_paths(spark, sf_dir):
    """Paths that end at the highest ranks, nearest first among equals."""
    ranks = literal(spark, "node pagerank", [("b", 0.1), ("c", 0.3), ("d", 0.5)])
    d = G.hops(literal(spark, "src relation dst", CHAIN), literal(spark, "seed", [("a",)]), 2, 3, ranks)
    return d.select("seed", "node", F.col("distance").cast("bigint").alias("distance"), "rank0")


@query("subgraph_of_seed", expected("kind name", [("node", "c"), ("node", "b"), ("node", "a"), ("edge", "a-r-b"), ("edge", "a-s-c"), ("edge", "b-r-c")]))
def subgraph_of_seed(spark, sf_dir):
    """The first three paths of a seed: its neighbours, then one step on."""
    ranks = literal(spark, "node pagerank", [("a", 0.1), ("b", 0.4), ("c", 0.4)])
    entities, relations = G.subgraph(literal(spark, "src relation dst", CHAIN), literal(spark, "seed", [("a",)]), ranks, 3)
    return entities.select(F.lit("node").alias("kind"), F.col("node").alias("name")).unionByName(relations.select(F.lit("edge").alias("kind"), F.concat_ws("-", "src", "relation", "dst").alias("name")))


@query("communities_of_triples", expected("src relation dst s_type o_type community_id", [("a", "r", "b", "T", None, "k1"), ("c", "r", "b", None, None, None)]))
def communities_of_triples(spark, sf_dir):
    t = literal(spark, "src relation dst", [("a", "r", "b"), ("c", "r", "b")])
    return G.communities_of(t, literal(spark, "name type", [("a", "T")]), literal(spark, "community_id node", [("k1", "a")]))


@query("edges_of_summary", expected("community_id src dst", [("k", "a", "b"), ("k", "a", "c")]))
def edges_of_summary(spark, sf_dir):
    """The first two edges inside a community, and nothing of the rest."""
    members = literal(spark, "community_id node", [("k", "a"), ("k", "b"), ("k", "c"), ("l", "d")])
    return G.inner_edges(literal(spark, "src relation dst", CHAIN), members, most=2).select("community_id", "src", "dst")


@query("sampled_graph", expected("src relation dst", CHAIN[:1] + CHAIN[3:]))
def sampled_graph(spark, sf_dir):
    return G.sampled_edges(literal(spark, "src relation dst", CHAIN), 2)


# --- jobs, states and sources -------------------------------------------------------------------
@query("faults_to_retry", expected("id", [(1,), (4,)]))
def faults_to_retry(spark, sf_dir):
    rows = [(1, "failed", "请求超时", 0), (2, "failed", "请求超时", 3), (3, "done", "超时", 0), (4, "failed", "ConnectError: x", None), (5, "failed", "bad file", 0), (6, "failed", None, 0)]
    d = literal(spark, "id status message tries", rows)
    return d.filter(R.retryable(F.col("status"), F.col("message"), F.col("tries"))).select(F.col("id").cast("bigint").alias("id"))


@query("counted_files", expected("status reason n", [("done", None, 2), ("failed", "解析过程失败", 1), ("too_large", "文件体积过大", 1), (None, None, 1)]))
def counted_files(spark, sf_dir):
    d = literal(spark, "id status", [(1, "done"), (2, "done"), (3, "failed"), (4, "too_large"), (5, None)])
    kept = R.counted(d).groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(None).cast("string").alias("reason"), "n")
    return kept.unionByName(R.excluded(d))


@query("jobs_due", expected("job_id action seconds", [("a", "run", 0), ("b", "retry", 120), ("c", "give_up", 0), ("d", "defer", 30)]))
def jobs_due(spark, sf_dir):
    """Back-off doubles with each try; jobs of other projects wait while one of first priority is at work."""
    t = "2026-01-01 00:00:00"
    jobs = literal(spark, "job_id project_id status message tries updated_at", [("a", "p", "pending", None, 0, t), ("b", "p", "failed", "server busy", 2, t), ("c", "p", "failed", "bad", 0, t), ("d", "q", "pending", None, 0, t)])
    jobs = jobs.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    projects = literal(spark, "project_id is_paused priority active", [("p", False, 1, 2), ("q", False, 2, 0)])
    now = F.lit(t).cast("timestamp")
    d = M.due(jobs, projects, now)
    return d.select("job_id", "action", F.timestamp_diff("SECOND", now, F.col("at")).alias("seconds"))


@query("jobs_rerouted", expected("id next", [(1, "slow"), (2, "fast"), (3, "slow"), (4, "slow")]))
def jobs_rerouted(spark, sf_dir):
    d = M.rerouted(literal(spark, "id queue kind scanned estimate", [(1, "fast", "pdf", True, 1), (2, "fast", "pdf", False, 300), (3, "fast", "txt", None, 301), (4, "slow", "txt", None, 1)]))
    return d.select(F.col("id").cast("bigint").alias("id"), "next")


@query("scheduled_runs", expected("job at", [("judge", "2026-01-02 19:00:00"), ("recover_faults", "2026-01-02 04:05:00"), ("snapshots", "2026-01-02 04:10:00")]))
def scheduled_runs(spark, sf_dir):
    """Daily at three by the clock of the zone, others at the next multiple of their interval; shown in UTC."""
    now = F.to_timestamp(F.lit("2026-01-02T04:00:00Z"))
    d = M.next_runs(spark, now)
    return d.select("job", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("caches_kept", expected("cache n oldest", [("answer", 3, 0), ("rewrite", 150, 100)]))
def caches_kept(spark, sf_dir):
    """250 entries of a cache of 200 let their 100 oldest go; one of another cache is past its time, and projects that changed lose theirs."""
    many = spark.range(250).select(F.lit("rewrite").alias("cache"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("age"), F.lit("p").alias("project_id"))
    few = spark.range(5).select(F.lit("answer").alias("cache"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("key"), F.col("id").alias("age"), F.when(F.col("id") == 3, "gone").otherwise("p").alias("project_id"))
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    d = many.unionByName(few).withColumn("ts", F.timestamp_add("SECOND", F.when((F.col("cache") == "answer") & (F.col("age") == 4), -9999).otherwise(F.col("age")).cast("int"), start))
    now = F.timestamp_add("SECOND", F.lit(250), start)
    d = R.invalidated(R.cache_entries(d, now, F.col("cache")), literal(spark, "project_id", [("gone",)]))
    return d.groupBy("cache").agg(F.count("*").alias("n"), F.min("age").alias("oldest"))


@query("pasted_texts", expected("id source_type", [(1, "text")]))
def pasted_texts(spark, sf_dir):
    return readers.pasted(literal(spark, "id text", [(1, "long enough text"), (2, "  short    ")])).select(F.col("id").cast("bigint").alias("id"), "source_type")


@query("work_left", expected("section_id", [(2,), (3,)]))
def work_left(spark, sf_dir):
    d = M.unfinished(literal(spark, "section_id", [(1,), (2,), (3,)]), literal(spark, "section_id", [(1,)]))
    return d.select(F.col("section_id").cast("bigint").alias("section_id"))


@query("order_of_readers", expected("place v", [(0, "9"), (1, "10"), (2, "1,000"), (3, "x"), (4, "")]))
def order_of_readers(spark, sf_dir):
    d = R.natural_order(literal(spark, "v", [("10",), ("9",), ("",), ("1,000",), ("x",)]), "v").withColumn("i", F.monotonically_increasing_id())
    return d.select((F.row_number().over(Window.orderBy("i")) - 1).cast("bigint").alias("place"), "v")


@query("references_left", expected("ref_id file_ids", [(1, "b"), (3, "")]))
def references_left(spark, sf_dir):
    d = spark.sql("SELECT * FROM VALUES (1, array('a', 'b')), (2, array('a')), (3, CAST(array() AS array<string>)) AS t(ref_id, file_ids)")
    return R.without_ids(d, ["a"]).select(F.col("ref_id").cast("bigint").alias("ref_id"), joined("file_ids").alias("file_ids"))


@query("listed_documents", expected("place id n_sections", [(0, 2, 0), (1, 1, 2), (2, 3, 2)]))
def listed_documents(spark, sf_dir):
    """Newest first, then by id."""
    d = spark.sql("SELECT * FROM VALUES (1, 't', array('a', 'b'), '2'), (2, 'u', CAST(array() AS array<string>), '3'), (3, 'v', array('c', 'd'), '2') AS t(id, title, sections, updated_at)")
    d = R.document_listing(d).withColumn("i", F.monotonically_increasing_id())
    return d.select((F.row_number().over(Window.orderBy("i")) - 1).cast("bigint").alias("place"), F.col("id").cast("bigint").alias("id"), F.col("n_sections").cast("bigint").alias("n_sections"))


@query("json_access", expected("id deep first dumped", [(1, "x", "7", '{"id":1,"names":["a","b"]}'), (2, None, None, '{"id":2}')]))
def json_access(spark, sf_dir):
    """Nested fields by their path, elements of lists, and a row written as JSON; nulls are left out."""
    d = literal(spark, "id text", [(1, '{"a": {"b": "x"}, "c": [7, 8], "n": ["a", "b"]}'), (2, "broken")])
    names = F.from_json(F.get_json_object("text", "$.n"), "array<string>")
    return d.select(F.col("id").cast("bigint").alias("id"), F.get_json_object("text", "$.a.b").alias("deep"), F.get_json_object("text", "$.c[0]").alias("first"), F.to_json(F.struct("id", names.alias("names"))).alias("dumped"))


@query("names_like", expected("query_id name rank0", [(1, "青山水库", 0), (1, "青山水库大坝", 1), (2, "清水镇", 0)]))
def names_like(spark, sf_dir):
    """Entities whose names' vectors are nearest to a question's, above a least similarity."""
    names = literal(spark, "name embedding", [("青山水库", [1.0, 0.0]), ("青山水库大坝", [0.8, 0.6]), ("清水镇", [0.0, 1.0])])
    asked = literal(spark, "query_id embedding", [(1, [1.0, 0.0]), (2, [-0.6, 0.8])])
    d = S.dense_search(asked, names, 5, item="name", least=0.5)
    return d.select(F.col("query_id").cast("bigint").alias("query_id"), "name", "rank0")
