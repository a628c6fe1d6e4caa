import io
import math
import re
import struct
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import identity, nlp, text
from brindle.operators import graph, relational, search, tables
from brindle.plans import sql_endpoint
from brindle.sources import readers, sinks
from brindle.streaming import monitors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- text ---------------------------------------------------------------------------------------
def test_paragraph_chunks():
    table = "| a | b |\n| 1 | 2 |"
    doc = "第一段的文字在这里，足够长的一段。\n\n" + "前文说明如下：\n" + table + "\n后文。\n\n" + "句子很长。" * 300
    chunks = text.paragraph_chunks(doc)
    assert any(table in c for c in chunks) and all(len(c) >= 20 for c in chunks)
    assert "".join(chunks).replace("\n", "") == doc.replace("\n", "")
    assert all(len(c) <= 512 for c in chunks)
    assert text.paragraph_chunks("") == text.paragraph_chunks(None) == [] == text.paragraph_chunks("short")
    big = "| x |\n" * 400
    assert text.paragraph_chunks(big) == [big.strip()]


def test_section_pieces():
    assert text.section_pieces("头\n" + "文" * 7000) and max(map(len, text.section_pieces("头\n" + "文" * 7000))) <= 3000


def test_text_columns(spark):
    c = F.col("t")
    assert one(spark, text.confidence(c), t="水库 水位 高程 流域 降雨量 的设计说明" * 10) == 1.0
    assert one(spark, text.confidence(c), t="  ") == 0.0
    assert [one(spark, text.semantic_role(c), t=t) for t in ("# Head", "第三章 总则", "| a |\n| b |", "- item", "plain")] == ["section_header", "section_header", "table", "list_item", "text_block"]
    assert [one(spark, text.heading_level(c), t=t) for t in ("一、总则", "第一章 总", "1 综合", "1. 综合", "1.1 x", "（二）x", "1.1.1", "1.1.1.1", "第2节 x", "1.自然")] == [1, 1, 1, 1, 2, 2, 3, 4, 2, 0]
    assert one(spark, text.without_thinking(c), t="a<think>b</think>c<think>d") == "ac"
    assert one(spark, text.json_body(c), t='x {"a": 1} y') == '{"a": 1}'
    assert one(spark, F.to_json(text.revisions(c)), t="[修改前: 甲 -> 修改后: 乙]") == '[{"before":"甲","after":"乙"}]'
    assert one(spark, text.safe_name(c), t="a b/c(1).txt") == "a_b_c_1_.txt"
    assert one(spark, text.fenced_html(c), t="x ```html\n<div>1</div>\n``` y") == "<div>1</div>"
    assert one(spark, text.without_drawing_noise(c), t="12.5\nreal text\n- 3\n5m") == "real text\n5m"
    assert one(spark, text.replaced(c, {"teh": "the"}), t="teh cat") == "the cat"


def test_identity(spark):
    name = "f1__chunk_3"
    assert one(spark, identity.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))
    for k in range(20):
        assert one(spark, identity.uuid5(F.lit(f"n{k}"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, f"n{k}"))


def test_language(spark):
    c = F.col("t")
    assert [one(spark, nlp.intent(c), t=t) for t in ("一共有多少", "最大的是", "造价", "对比一下", "总结", "关联", "风险", "hi")] == ["data_analysis", "table_stats", "data_lookup", "comparison", "summary", "graph_focus", "risk_analysis", "general_qa"]
    assert [one(spark, nlp.is_simple(c), t=t) for t in ("你好！", "Who are you?", "水库的水位是多少")] == [True, True, False]
    assert one(spark, nlp.rewritten(c, F.lit("项目")), t="桩号 K12+300 的 3 km 渠道断面 3KM") == "项目 K12+300 3KM 渠道断面"
    assert one(spark, nlp.resolved(c, F.lit("幸福水库 根据 120 万元")), t="这个多少") == "这个多少 幸福水库 万元 120 万元"
    assert one(spark, F.array_join(nlp.form_fields(c), ","), t="罚款依据") == "penalty_type,fine_amount_yuan,legal_basis"
    assert [one(spark, nlp.judged(F.lit(v))) for v in ("0.7", "x", "3")] == [0.7, 0.5, 1.0]
    ok = nlp.valid_record(c)[1]
    assert one(spark, ok, t='{"company_name":"a","credit_code":"91330000MA27XXXX12","penalty_type":"罚款","legal_basis":"x"}')
    assert not one(spark, ok, t="not json")
    assert one(spark, nlp.filled(F.lit("a b"), nlp.slots(c)), t='[{"old":"a","new":"c","type":"x"}]') == "c b"


# --- SQL endpoint -------------------------------------------------------------------------------
def test_guard(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sql_endpoint.run_sql(spark, "SELECT sum(id) AS s FROM numbers;").first().s == 3
    assert sql_endpoint.run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT 'drop' AS \"the word\" FROM a").columns == ["the word"]
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM x", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT `reflect` ('java.lang.System', 'exit', 1)", "INSERT INTO x SELECT 1"):
        with pytest.raises(sql_endpoint.Refused):
            sql_endpoint.check(bad)
    outside = (
        "SELECT TRANSFORM(id) USING 'sh -c \"touch /tmp/never\"' AS (x) FROM numbers",
        "WITH a AS (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM numbers) SELECT * FROM a",
        "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM numbers)",
        "SELECT * FROM parquet.`/x`", "SELECT * FROM parquet/**/.`/x`", "SELECT (SELECT max(a) FROM csv.`/x`) AS m", "SELECT * FROM default.numbers",
        "SELECT reflect/**/('java.lang.System', 'exit', 1)",
    )
    for bad in outside:
        with pytest.raises(sql_endpoint.Refused):
            sql_endpoint.run_sql(spark, bad)
    for key in ("spark.sql.runSQLOnFiles", "spark.sql.ansi.doubleQuotedIdentifiers"):
        before = spark.conf.get(key)
        sql_endpoint.run_sql(spark, "SELECT 1 AS x")
        assert spark.conf.get(key) == before
    assert sql_endpoint.with_back_ticks("""SELECT "a ""b", 'c "d"', `e"f` -- "g"\nFROM "h`i\"""") == """SELECT `a "b`, 'c "d"', `e"f` -- "g"\nFROM `h``i`"""
    for bad in ("WITH a AS (SELECT 1) SELECT 2", "SELECT 'drop'"):
        with pytest.raises(sql_endpoint.Refused):
            sql_endpoint.check(bad, strict=True)
    tries = iter(["SELECT nothing FROM nowhere", "SELECT 5 AS five"])
    df, problem = sql_endpoint.answered(spark, "?", lambda q, p: next(tries))
    assert df.first().five == 5 and not problem
    lines, md = sql_endpoint.formatted(spark.sql("SELECT 1.5D AS a, CAST(NULL AS INT) AS b, 'x|y' AS c"))
    assert lines == ["a=1.5, c=x|y"] and md.split("\n")[2] == "| 1.5 |  | x&#124;y |"


# --- tables -------------------------------------------------------------------------------------
def test_table_extraction(spark):
    rows = [["统计表", "统计表", "统计表", ""], ["单位：亩", "", "", ""], ["名称", "面积", "面积", ""], ["名称", "耕地面积", "林地面积", ""], ["甲", "1", "nan", ""], ["", "2", "3", ""], ["", "", "", ""]]
    m = spark.createDataFrame([("t", rows)], "table_id string, rows array<array<string>>")
    cells = tables.trimmed(tables.cells_of(m))
    ranges = spark.createDataFrame([("t", 4, 0, 5, 0)], "table_id string, r0 int, c0 int, r1 int, c1 int")
    full = tables.rows_of(tables.merged_filled(cells, ranges))
    heads = tables.with_headers(full)
    h = heads.first()
    assert h.headers == ["名称", "面积_耕地面积", "面积_林地面积"] and h.unit == "单位：亩" and h.title == "统计表"
    data = sorted(tables.data_rows(full, heads).collect(), key=lambda r: r.r)
    assert [r.row for r in data] == [["甲", "1", ""], ["甲", "2", "3"]]
    assert tables.merged_column_numbers(ranges).collect()[0].c == 0
    h, r = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit(""))
    assert one(spark, tables.row_text(h, r)) == "a: 1"
    assert one(spark, tables.without_neighbour_repeats(F.array(*map(F.lit, "aab")), F.lit(3))) == ["a", "b", ""]
    md = one(spark, tables.markdown_of(h, F.array(r)))
    assert one(spark, tables.markdown_rows(F.lit(md))) == [["a", "b"], ["1", ""]]
    assert one(spark, tables.is_false_table(F.array(F.array(F.lit("x"), F.lit("")), F.array(F.lit(""), F.lit("")))))
    half = spark.createDataFrame([("1",), ("2",), ("x",), ("y",)], "v string")
    assert tables.typed(half).dtypes == [("v", "string")] and tables.typed(half.limit(2)) is None
    assert tables.typed(half.filter("v <> 'y'")).dtypes == [("v", "double")]


def test_titles(spark):
    a = spark.createDataFrame([("p", 1, "表1 土地面积统计"), ("p", 2, "表2 土地面积统计表")], "project_id string, wanted_id int, title string")
    b = spark.createDataFrame([("p", 10, "土地面积统计"), ("p", 11, "完全无关")], "project_id string, have_id int, title string")
    assert [(r.wanted_id, r.have_id) for r in tables.matched_titles(a, b).collect()] == [(1, 10)]


def test_blocks_and_filters(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 2.0)], "b int, v double")
    assert relational.once_per_block(df, "v", "b").first().total == 8.0 and relational.once_per_block(df, "v", None).first().total == 13.0
    assert relational.keep_if_any(df, F.col("v") > 99).count() == 4 and relational.keep_if_any(df, F.col("v") > 4).count() == 2
    assert one(spark, relational.plot_variants(F.lit("地块 007# 和地块 12"))) == ["007", "7", "12", "012"]
    assert one(spark, relational.same_entity_candidate(F.lit("云岭渠道"), F.lit("云岭渠道改造"))) and not one(spark, relational.same_entity_candidate(F.lit("图7"), F.lit("图8")))
    refs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "ref_id int, file_ids array<string>")
    assert {r.ref_id: r.file_ids for r in relational.without_ids(refs, ["a"]).collect()} == {1: ["b"], 3: []}
    assert {r.bucket: r.n for r in relational.histogram(df, F.col("v"), [0, 2, 9]).collect()} == {"0-2": 1, "2-9": 3, "9+": 0}


# --- search and graphs --------------------------------------------------------------------------
def test_greedy_acceptance(spark):
    rows = [("q", 1, 0, 0.9, "abcdefgh"), ("q", 2, 0, 0.8, "abcdefgx"), ("q", 3, 0, 0.7, "zzzzyyyy"), ("q", 4, 0, 0.6, "other text")]
    got = search.accepted(spark.createDataFrame(rows, "query_id string, doc_id int, chunk_index int, score double, document string"), 2)
    assert [r.doc_id for r in got.orderBy("rank0").collect()] == [1, 3]


def test_pagerank_by_dense_solution(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c")]
    got = {r.node: r.pagerank for r in graph.pagerank(spark.createDataFrame([(a, "r", b) for a, b in e], "src string, relation string, dst string")).collect()}
    names, links = "abcd", {(a, b) for x, y in e for a, b in ((x, y), (y, x))}
    m = np.array([[1.0 if (b, a) in links else 0.0 for b in names] for a in names])
    m /= m.sum(axis=0)
    r = np.full(4, 0.25)
    for _ in range(200):
        r = 0.15 / 4 + 0.85 * m @ r
    assert np.allclose([got[n] for n in names], r, atol=2e-5)
    with pytest.raises(RuntimeError):
        graph.pagerank(spark.createDataFrame([("a", "r", "b"), ("b", "r", "c")], "src string, relation string, dst string"), tolerance=1e-15, most_rounds=5)


def test_entity_resolution(spark):
    v = spark.createDataFrame([(n,) for n in ("ab", "abc", "abcd", "z")], "name string")
    e = spark.createDataFrame([("abc", "r", "z"), ("abcd", "r", "z"), ("ab", "s", "abc")], "src string, relation string, dst string")
    p = spark.createDataFrame([("ab", "abc"), ("abc", "abcd")], "a string, b string")
    names, vertices, edges = graph.resolved_entities(v, e, p)
    assert {(r.src, r.relation, r.dst) for r in edges.collect()} == {("ab", "r", "z")}
    assert {r.name: r.aliases for r in vertices.collect()} == {"ab": ["abc", "abcd"], "z": []}


# --- sources, sinks, streams --------------------------------------------------------------------
def office(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return data.getvalue()


def test_files(spark, tmp_path):
    sheet = '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C2"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></w>'
    xlsx = office({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>head</t></si></s>", "xl/worksheets/sheet1.xml": sheet})
    docx = office({"word/document.xml": "<d><body><p><r><t>para</t></r></p><tbl><tr><tc><p><t>x</t></p></tc><tc><p><t>y</t></p></tc></tr></tbl></body></d>"})
    (tmp_path / "a.xlsx").write_bytes(xlsx)
    (tmp_path / "b.docx").write_bytes(docx)
    (tmp_path / "c.txt").write_bytes("gut\xff".encode("latin-1"))
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.xlsx": "head\n7", "b.docx": "para\nx | y", "c.txt": "gut", "d.bin": None, "e.docx": None}
    t = readers.read_tables(spark, str(tmp_path)).first()
    assert t.sheet == "S" and t.rows == [["head", "", ""], ["", "", "7"]] and t.merged == [[0, 0, 1, 1]]


def test_job_states_and_sinks(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"file_id": "a", "status": "done"}')
    assert readers.job_states(spark, str(tmp_path)).first().auto_retry_count is None
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, part string")
    sinks.write_partitioned(df, str(tmp_path / "p"), "part")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert one(spark, sinks.key_values(["a", "b"]), a=1, b="z") == "a=1, b=z"


def test_thinking_across_borders():
    pieces = ["a<th", "ink>hid", "den</thi", "nk>b<", "c"]
    state, out = (False, ""), []
    for p in pieces:
        state, seen = monitors.strip_thinking(state, p)
        out.append(seen)
    assert "".join(out) == "ab<c"


def run_stream(spark, df, path, build, mode="append"):
    df.write.parquet(path)
    name = "q" + uuid.uuid4().hex
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, k, p) for k, p in enumerate(["a<th", "ink>x</think", ">b"])] + [(2, 0, "plain")]
    got = run_stream(spark, spark.createDataFrame(rows, "stream_id int, seq bigint, piece string"), str(tmp_path / "s"), monitors.visible)
    assert "".join(r.visible for r in got.orderBy("stream_id", "seq").collect()) == "abplain"
    rows = [(1, k, f) for k, f in enumerate([True, True, False, True, True, True, False])]
    got = run_stream(spark, spark.createDataFrame(rows, "job_id int, seq bigint, failed boolean"), str(tmp_path / "t"), monitors.tripped)
    assert [r.tripped for r in got.orderBy("seq").collect()] == [False] * 5 + [True, True]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    got = run_stream(spark, events, str(tmp_path / "u"), lambda d: monitors.one_pass(d, "event_type", "value"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monitors.one_pass(events, "event_type", "value").collect()))
    got = run_stream(spark, events, str(tmp_path / "v"), monitors.snapshots, "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_more_text(spark):
    c = F.col("t")
    assert one(spark, text.translated(c, {"DLMC": "地类名称"}), t="dlmc") == "dlmc(地类名称)" and one(spark, text.translated(c, {"A": "b"}), t="x") == "x"


def test_deferral_and_models(spark):
    from brindle.operators.models import mixture, projected

    jobs = spark.createDataFrame([("j1", "a"), ("j2", "b"), ("j3", "c")], "job string, project_id string")
    projects = spark.createDataFrame([("a", False, 1, 2), ("b", False, None, 0), ("c", True, 1, 0)], "project_id string, is_paused boolean, priority int, active int")
    assert {r.job for r in relational.deferred(jobs, projects).collect()} == {"j2", "j3"}
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 5)), rng.normal(3, 0.1, (60, 5))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id int, embedding array<double>")
    got = np.array([r.xy for r in projected(df).orderBy("vec_id").collect()])
    centred = x - x.mean(axis=0)
    assert np.allclose(np.sort(got.var(axis=0))[::-1], np.linalg.svd(centred)[1][:2] ** 2 / len(x))
    labels = [r.cluster for r in mixture(df, 3, dimensions=2).orderBy("vec_id").collect()]
    assert len(set(labels[:60])) == 1 and set(labels[:60]).isdisjoint(labels[60:])


def test_more_graph_and_order(spark):
    chunks = spark.createDataFrame([(1, 0, "罚款"), (1, 1, "x")], "doc_id int, chunk_index int, document string")
    tree = {tuple(r) for r in graph.document_tree(chunks, nlp.form_fields(F.col("document"))).collect()}
    assert tree == {("1", "HAS_ELEMENT", "1#0"), ("1", "HAS_ELEMENT", "1#1"), ("penalty_type", "EVIDENCE_BY", "1#0"), ("fine_amount_yuan", "EVIDENCE_BY", "1#0"), ("legal_basis", "EVIDENCE_BY", "1#0")}
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")], "src string, relation string, dst string")
    ranks = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.4)], "node string, pagerank double")
    entities, relations = graph.subgraph(e, spark.createDataFrame([("a",)], "seed string"), ranks)
    assert [r.node for r in entities.collect()] == ["b", "c", "a"] and [tuple(r) for r in relations.collect()] == [("a", "r", "b"), ("b", "r", "c")]
    c = spark.createDataFrame([(k,) for k in range(7)], "community_id int")
    page, more = graph.pending(c, c.filter("community_id = 0"))
    assert [r.community_id for r in page.collect()] == [1, 2, 3, 4, 5] and more
    v = spark.createDataFrame([("10",), ("9",), ("",), ("1,000",), ("x",), (None,)], "v string")
    assert [r.v for r in relational.natural_order(v, "v").collect()][:4] == ["9", "10", "1,000", "x"]
    assert relational.spread_rows(spark.range(100).withColumn("k", F.lit(1)), "k", "id").count() == 15
    d = spark.createDataFrame([(1, "t", ["a", "b"], "2"), (2, "u", [], "3")], "id int, title string, sections array<string>, updated_at string")
    assert [(r.id, r.n_sections) for r in relational.document_listing(d).collect()] == [(2, 0), (1, 2)]


def test_mixture_of_one(spark):
    import numpy as np

    from brindle.operators.models import mixture

    r = np.random.default_rng(6)
    one = [(k, [float(x) for x in r.normal(0, 1, 2)]) for k in range(300)]
    got = mixture(spark.createDataFrame(one, "vec_id int, embedding array<double>"), 3, dimensions=2).collect()
    assert {x.cluster for x in got} == {0} and len(got) == 300


def test_latest_sink(spark, tmp_path):
    path = str(tmp_path / "latest")
    write = monitors.latest_sink(path, "k")
    assert monitors.latest_table(spark, path) is None
    batch = lambda rows: spark.createDataFrame(rows, "k int, version int, v string")
    write(batch([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")]), 0)
    write(batch([(2, 5, "d"), (3, 1, "e"), (1, 1, "late")]), 1)
    want = [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]
    assert sorted(map(tuple, monitors.latest_table(spark, path).collect())) == want
    write(batch([(2, 5, "d"), (3, 1, "e"), (1, 1, "late")]), 1)  # the same batch again
    assert sorted(map(tuple, monitors.latest_table(spark, path).collect())) == want


def dbf(fields, rows, encoding):
    length = 1 + sum(w for _, _, w in fields)
    head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(rows), 32 + 32 * len(fields) + 1, length)
    for name, kind, width in fields:
        head += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    body = b"".join(flag + b"".join(v.encode(encoding).ljust(w) for v, (_, _, w) in zip(r, fields)) for flag, r in rows)
    return head + b"\r" + body + b"\x1a"


def test_attribute_tables(spark, tmp_path):
    fields = [("DLMC", "C", 12), ("TBMJ", "N", 8)]
    (tmp_path / "a.dbf").write_bytes(dbf(fields, [(b" ", ("旱地", "12.5")), (b"*", ("gone", "1")), (b" ", ("水田", ""))], "gbk"))
    (tmp_path / "b.dbf").write_bytes(dbf([("DLMC", "C", 12), ("X", "C", 3)], [(b" ", ("林地", "7"))], "utf-8"))
    d = readers.dbf_table(spark, str(tmp_path))
    assert d.columns == ["path", "record", "DLMC", "TBMJ", "X"] and dict(d.dtypes)["TBMJ"] == "double"
    assert sorted(((r.path[-5:], r.DLMC, r.TBMJ, r.X) for r in d.collect()), key=str) == [("a.dbf", "旱地", 12.5, None), ("a.dbf", "水田", None, None), ("b.dbf", "林地", None, "7")]


def test_office_tables_and_roles(spark, tmp_path):
    cell = lambda t, extra="": f"<tc><tcPr>{extra}</tcPr><p><r><t>{t}</t></r></p></tc>"
    table = f"<tbl><tr>{cell('head', '<gridSpan val="2"/>')}</tr><tr>{cell('a', '<vMerge val="restart"/>')}{cell('1')}</tr><tr>{cell('', '<vMerge/>')}{cell('2')}</tr></tbl>"
    body = f'<d><body><p><pPr><pStyle val="Heading1"/></pPr><r><t>Title</t></r></p><p><pPr><numPr/></pPr><r><t>item</t></r></p><p><r><t>text</t></r></p>{table}</body></d>'
    (tmp_path / "a.docx").write_bytes(office({"word/document.xml": body}))
    slide = '<s><sp><nvPr><ph type="title"/></nvPr><txBody><p><r><t>Slide</t></r></p></txBody></sp><sp><txBody><p><r><t>words</t></r></p></txBody></sp><tbl><tr><tc><txBody><p><r><t>x</t></r></p></txBody></tc></tr></tbl></s>'
    (tmp_path / "b.pptx").write_bytes(office({"ppt/slides/slide1.xml": slide}))
    got = {r.path[-6:]: r for r in readers.read_tables(spark, str(tmp_path)).collect()}
    assert got["a.docx"].rows == [["head", "head"], ["a", "1"], ["a", "2"]] and got["b.pptx"].rows == [["x"]]
    texts = {r.path[-6:]: r.text for r in readers.read_files(spark, str(tmp_path), marked=True).collect()}
    assert texts["a.docx"] == "## Title\n\n- item\n\ntext\n\n[表格]\nhead\na | 1\n | 2" and texts["b.pptx"] == "## Slide\n\nwords\n\n[表格]\nx"


def test_exports_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名称,SHAPE,v\n甲,x,1\n乙,y,2\n".encode("gbk"))
    d = readers.delimited(spark, str(tmp_path / "a.csv"))
    assert d.columns == ["名称", "v"] and sorted(map(tuple, d.collect())) == [("乙", "2"), ("甲", "1")]
    assert readers.preview(d, 1).count() == 1
    names = spark.createDataFrame([("MSysObjects",), ("GDB_Items",), ("land",)], "n string")
    assert [r.n for r in names.filter(~readers.is_system_table(F.col("n"))).collect()] == ["land"]


def test_pages_of_files(spark):
    rows = [("a", 1, "x" * 100, None, ["| t |"]), ("a", 2, "few", "recognised", None), ("b", 1, "", "scan", None), ("b", 2, None, None, None)]
    d = spark.createDataFrame(rows, "file_id string, page_no int, text string, ocr string, tables array<string>")
    got = {r.file_id: (r.route, r.text) for r in readers.page_documents(d, scanned_least=40).collect()}
    assert got == {"a": ("fast", "x" * 100 + "\n\n| t |\n\nrecognised"), "b": ("slow", "scan")}


def test_deletes_and_clones(spark):
    chunks = spark.createDataFrame([("f", 0, "t", "old"), ("g", 0, "u", "old")], "file_id string, chunk_index int, document string, chunk_id string")
    edges = spark.createDataFrame([("a", "r", "b", "f"), ("b", "r", "c", "g")], "src string, relation string, dst string, file_id string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    left = sinks.delete_files({"chunks": chunks}, edges, names, spark.createDataFrame([("f",)], "file_id string"))
    assert {k: v.count() for k, v in left.items()} == {"chunks": 1, "edges": 1, "vertices": 2}
    new = sinks.cloned(chunks, spark.createDataFrame([("f", "h"), ("f", "i")], "file_id string, new_file_id string")).collect()
    assert {r.file_id for r in new} == {"h", "i"} and len({r.chunk_id for r in new} | {"old"}) == 3


def test_bounded_paths_and_communities(spark):
    rng = np.random.default_rng(2)
    e = sorted({(f"n{a}", "r", f"n{b}") for a, b in rng.integers(0, 9, (16, 2)) if a != b})
    edges = spark.createDataFrame(e, "src string, relation string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "seed string")
    every = [tuple(r) for r in graph.hops(edges, seeds, 3).select("seed", "distance", "nodes", "relations").collect()]
    for most in (1, 4, 11):
        got = sorted(tuple(r) for r in graph.hops(edges, seeds, 3, most).select("seed", "distance", "nodes", "relations").collect())
        assert got == sorted(r for s in ("n0", "n1") for r in sorted((x for x in every if x[0] == s), key=lambda x: x[1:])[:most])
    star = [("hub", "r", f"leaf{k:03d}") for k in range(40)] + [("x", "r", "y"), ("y", "r", "z")]
    parts = [set(r.members) for r in graph.communities(spark.createDataFrame(star, "src string, relation string, dst string"), most=15).collect()]
    # The leaves that are not in the hub's part have no link left, and single nodes are no communities.
    assert {"x", "y", "z"} in parts and [len(p) <= 15 for p in parts if "hub" in p] == [True] and len(parts) == 2
    assert graph.communities(spark.createDataFrame(star[:3], "src string, relation string, dst string")).count() == 0


def test_names_that_hold_words(spark):
    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice(list("abcé1"), rng.integers(0, 9))) for _ in range(200)})
    words = sorted({"".join(rng.choice(list("abcé1x"), rng.integers(0, 4))) for _ in range(40)})
    got = graph.entities_holding(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((w, n) for w in words for n in names if w and w in n)


def test_candidates_by_all_pairs(spark):
    from brindle.operators.relational import same_entity_candidate

    rng = np.random.default_rng(6)
    names = [(str(k % 2) if k % 7 else None, "".join(rng.choice(list("abcA12"), rng.integers(1, 7)))) for k in range(120)]
    df = spark.createDataFrame(names, "type string, name string").distinct()
    both = df.select("type", F.col("name").alias("a")).crossJoin(df.select(F.col("type").alias("t"), F.col("name").alias("b"))).filter(F.col("type").eqNullSafe(F.col("t")) & (F.col("a") < F.col("b")))
    pair = lambda s: {s[i : i + 2].lower() for i in range(len(s) - 1)} or {s.lower()}
    want = sorted((r.type or "", r.a, r.b) for r in both.filter(same_entity_candidate(F.col("a"), F.col("b"))).collect() if pair(r.a) & pair(r.b))
    assert sorted((r.type or "", r.a, r.b) for r in graph.candidate_pairs(df).collect()) == want and len(want) > 10


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(k, rng.normal(0, 1, 4).tolist()) for k in range(60)], "item_id int, embedding array<double>")
    q = v.filter("item_id < 25").withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, search.dense_search(q, v, 3).collect()))
    old, search.BROADCAST_ROWS = search.BROADCAST_ROWS, 7
    try:
        block = lambda part: search.top_k(v.select("item_id", "embedding").crossJoin(part).select("query_id", "item_id", search.dot(F.col("qv"), F.col("embedding")).alias("score")), "query_id", 3, F.desc("score"), F.asc("item_id"))
        got = search.in_blocks(q.select("query_id", F.col("embedding").alias("qv")), block, most=7)
    finally:
        search.BROADCAST_ROWS = old
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()) == [(a, b, round(c, 9), d) for a, b, c, d in want]


def test_search_chain_by_its_definition(spark):
    """The whole chain against plain Python on a small corpus, with and without summaries."""
    rng = np.random.default_rng(4)
    words = "高程 投资 坝顶 渠道 水库 灌溉 面积 地形 管径 说明 概况 120 300 45".split()
    vec = lambda: (lambda x: (x / np.linalg.norm(x)).tolist())(rng.normal(0, 1, 6))
    chunks = [(d, k, " ".join(rng.choice(words, rng.integers(3, 9))) + f" d{d}", vec()) for d in range(30) for k in range(rng.integers(1, 5))]
    summaries = [(d, 0, " ".join(t for e, _, t, _ in chunks if e == d)[:200], vec()) for d in range(0, 30, 2)]
    questions = [(1, "坝顶高程是多少", vec()), (2, "地型 概况 水库", vec()), (3, "灌溉 渠道", vec())]
    schema = "doc_id int, chunk_index int, document string, embedding array<double>"
    c, s = spark.createDataFrame(chunks, schema), spark.createDataFrame(summaries, schema)
    q = spark.createDataFrame(questions, "query_id int, text string, embedding array<double>")
    for given in (None, s):
        got = {}
        for r in search.hybrid_search(q, c, given, k=4).orderBy("query_id", "rank0").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index, r.document))
        assert got == chain(questions, chunks, None if given is None else summaries, 4)


def chain(questions, chunks, summaries, k):
    terms = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]

    def lists(question, vector, rows, pool, allowed):
        df = {}
        for r in rows:
            for t in set(terms(r[2])):
                df[t] = df.get(t, 0) + 1
        seen = [r for r in rows if allowed is None or r[0] in allowed]
        dense = sorted(seen, key=lambda r: (-sum(a * b for a, b in zip(r[3], vector)), r[:2]))[:pool]
        weigh = lambda r: round(sum((1 + math.log(terms(r[2]).count(t))) * math.log1p(len(rows) / df[t]) for t in sorted(set(terms(question))) if t in terms(r[2])), 6)
        sparse = sorted((r for r in seen if weigh(r) > 0), key=lambda r: (-weigh(r), r[:2]))[:pool]
        score = {}
        for one in (dense, sparse):
            for at, r in enumerate(one):
                score[r[:2]] = score.get(r[:2], 0) + 1 / (2 + at)
        return sorted(((round(v, 9), key) for key, v in score.items()), key=lambda x: (-x[0], x[1]))[:pool]

    out, text = {}, {r[:2]: r[2] for r in chunks}
    for number, question, vector in questions:
        question = question.replace("地型", "地形").replace("田形", "田型")
        files, allowed = len({r[0] for r in chunks}), None
        if summaries is not None and files > 20:
            best = 12 if files > 50 else 8
            allowed = {key[0] for _, key in lists(question, vector, summaries, best, None)}
            files = best
        pool = max(k * (4 if files <= 5 else 6 if files > 50 else 5), 30)
        hits = lists(question, vector, chunks, pool, allowed)[:20]
        own = [w for w in search.BOOST_WORDS if w in question]
        fits = lambda t: any(w in t for w in search.BOOST_WORDS) and any(ch.isdigit() for ch in t) and (not own or any(w in t for w in own))
        ahead = [h for h in hits[:15] if any(w in question for w in search.DATA_WORDS) and fits(text[h[1]])]
        rest = [h for h in hits[:15] if h not in ahead] or hits[15:20]
        share = lambda h: len(set(terms(question)) & set(terms(text[h[1]]))) / max(1, len(set(terms(question))))
        rest = sorted(rest, key=lambda h: -share(h))[: max(2 * k - len(ahead), 1)]
        score = {}
        for v, (d, i) in ahead + rest:
            for at in (i - 1, i, i + 1):
                if (d, at) in text:
                    score[d, at] = max(score.get((d, at), 0), v if at == i else v * 0.9)
        runs = []
        for d, i in sorted(score):
            if runs and runs[-1][-1] == (d, i - 1):
                runs[-1].append((d, i))
            else:
                runs.append([(d, i)])
        merged = sorted(((-max(score[x] for x in r), *r[0], "\n\n".join(text[x] for x in r)) for r in runs), key=lambda x: x[:3])
        grams = lambda t: (lambda u: {u[i : i + 3] for i in range(len(u) - 2)} or {u})(re.sub(r"\s+", "", t))
        kept = []
        for _, d, i, t in merged:
            if len(kept) < k and not any(len(grams(t) & grams(x[2])) / len(grams(t) | grams(x[2])) > 0.6 for x in kept):
                kept.append((d, i, t))
        out[number] = kept
    return out
