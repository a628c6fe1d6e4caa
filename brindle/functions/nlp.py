"""Rule paths of the language steps: intents, rewriting, reference resolution and form fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intents with their words, tried in this order, and the retrieval plan of each intent.
INTENT_WORDS = {
    "data_analysis": "总共 一共 共有 合计 总计 总数 统计 汇总 整个 全部 所有 总面积 总投资 总工程量 合计长度 合计面积 合计数量 多少根 多少个 多少条 按照 分组 分类汇总",
    "table_stats": "列出所有 全部列出 有哪些 最大 最小 平均 排名 前几 前五 前十 分布 占比 比例 多少",
    "data_lookup": "是几 数据 造价 金额 面积 长度 数量 高程 坡比 投资 定额 指标 参数 单价 工程量",
    "comparison": "对比 比较 区别 哪个好 优劣 方案一 方案二 差异 不同",
    "summary": "总结 概述 整体 全面 总体 综述 全貌 概况 简介 介绍 总览 梳理 主要内容 整个项目 项目情况",
    "graph_focus": "涉及 关联 关系 哪些实体 知识图谱",
    "risk_analysis": "风险 问题 隐患 难点 注意 防范 措施 建议 对策",
}
#: intent: (vector rows, graph paths, tables, community, table statistics, data analysis)
PLANS = {
    "data_analysis": (2, 0, 0, False, False, True),
    "table_stats": (4, 2, 3, False, True, False),
    "data_lookup": (6, 4, 3, False, False, False),
    "graph_focus": (8, 12, 1, True, False, False),
    "summary": (8, 12, 1, True, False, False),
    "comparison": (8, 8, 4, True, False, False),
    "general_qa": (8, 8, 3, False, False, False),
}
# Words that point back, generic words, question openers, and measures.
POINTERS = "上面 之前 那个 这个 刚才 前面 它的 这些 那些 上述".split()
GENERIC = "根据 参考 资料 显示 可以 其中 以下 如下 来源 项目 数据 信息 内容 文件 建议 分析 总结 相关 关于 目前 具体".split()
OPENERS = "什么是 怎么样 有没有 是不是 能不能 请问下 帮我看 请问你 帮我查 告诉我 介绍一 解释下 说说看 分析一 主要有 包括哪 是否有 有哪些".split()
MEASURE = r"[\d.]+\s*(?:万元|亿元|元|米|m|km|公里|亩|公顷|ha|%|min|h|d|cm|mm|kg|吨|MPa)"
UNIT = r"(?i)\d+\s*(?:min|h|d|s|ms|km|m|mm|cm|ha|亩|吨|kg|MPa)"
CODE = r"[a-zA-Z]?\d+\+\d+(?:\.\d+)?|(?=[a-zA-Z0-9_-]*[a-zA-Z])(?=[a-zA-Z0-9_-]*\d)[a-zA-Z0-9_-]+"
GREETINGS = "你好 嗨 在吗 你是谁 我是谁 你好啊 你好呀 谢谢 感谢 好的 收到 明白 ok hi hello hey thanks help".split()
IDENTITY = ["你是谁", "自我介绍", "你的角色", "你的功能", "你能做什么", "干什么的", "干嘛的", "什么助手", "who are you", "who am i", "what can you do"]
FIELDS = {
    "credit_code": r"\b[0-9A-HJ-NP-RT-UW-XY]{18}\b|信用代码",
    "company_name": "有限责任公司|有限公司|商行|合作社|经营部|制品厂|当事人|被处罚人",
    "penalty_type": "罚款|警告|暂扣|吊销",
    "fine_amount_yuan": "罚款|元",
    "legal_basis": "依据|根据|违反|触犯|条|款|项|法规",
}


def intent(message: Column, words: dict[str, str] | None = None, otherwise: str = "general_qa") -> Column:
    """The first intent with one of its words in the message."""
    out = F.lit(None).cast("string")
    for name, listed in reversed((words or INTENT_WORDS).items()):
        out = F.when(F.trim(message).rlike("|".join(listed.split())), name).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def intent_of_scores(table_stats: Column, graph: Column, community: Column, vector: Column, analysis: Column) -> Column:
    return (
        F.when(analysis >= 0.7, "data_analysis")
        .when(table_stats >= 0.7, "table_stats")
        .when((table_stats >= 0.5) & (vector < 0.6), "data_lookup")
        .when(graph >= 0.7, "graph_focus")
        .when(community >= 0.7, "summary")
        .when((vector >= 0.5) & (community >= 0.5), "comparison")
        .otherwise("general_qa")
    )


def plans(spark) -> DataFrame:
    """The dimension of retrieval plans by intent."""
    rows = [(k, *v) for k, v in PLANS.items()]
    return spark.createDataFrame(rows, "intent string, vector_top_k int, graph_max_paths int, table_max int, inject_community boolean, inject_table_stats boolean, inject_data_analysis boolean")


def with_plan(messages: DataFrame, plan: DataFrame, analysis: Column, table_stats: Column, community: Column) -> DataFrame:
    """messages (with intent) and their plans, scores of a half or more switching a branch on. An intent that has no plan of
    its own takes that of general_qa."""
    known = F.when(F.col("intent").isin(*PLANS), F.col("intent")).otherwise("general_qa")
    d = messages.withColumn("__plan", known).join(F.broadcast(plan.withColumnRenamed("intent", "__plan")), "__plan", "left").drop("__plan")  # seven rows
    return (
        d.withColumn("inject_data_analysis", F.coalesce("inject_data_analysis", F.lit(False)) | (analysis >= 0.5))
        .withColumn("inject_table_stats", F.coalesce("inject_table_stats", F.lit(False)) | (table_stats >= 0.5))
        .withColumn("inject_community", F.coalesce("inject_community", F.lit(False)) | (community >= 0.5))
    )


def is_simple(message: Column) -> Column:
    """Greetings and questions about the assistant itself, up to 40 characters."""
    m = F.lower(F.trim(message))
    plain = F.regexp_replace(m, r"[^\w一-龥]", "")
    return (F.length(m) <= 40) & (plain.isin(GREETINGS) | m.rlike("|".join(IDENTITY)))


def first_of_each(values: Column) -> Column:
    """Distinct up to case and blanks, the first of each."""
    key = lambda v: F.lower(F.replace(v, F.lit(" "), F.lit("")))
    return F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda acc, v: F.when(F.exists(acc, lambda a: key(a) == key(v)), acc).otherwise(F.concat(acc, F.array(v))),
    )


def rewritten(message: Column, project: Column) -> Column:
    """The project's name and the codes, measures and nouns of a message; the message itself if it has none."""
    codes = F.regexp_extract_all(message, F.lit(CODE), 0)
    measures = F.slice(F.regexp_extract_all(message, F.lit(UNIT), 0), 1, 3)
    nouns = F.regexp_extract_all(message, F.lit("[一-龥]{3,8}"), 0)
    nouns = F.slice(F.filter(nouns, lambda v: ~v.isin(OPENERS)), 1, 5)
    terms = first_of_each(F.concat(codes, measures, nouns))
    return F.trim(F.concat(project, F.lit(" "), F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(message)))


def last_reply(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with reply: the text of the latest earlier assistant turn."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("reply", F.last(F.when(F.col("role").isin("assistant", "agent"), F.col("text")), ignorenulls=True).over(w))


def resolved(message: Column, reply: Column, pointers: list[str] | None = None, noun: str = "[一-龥]{2,8}") -> Column:
    """A message that points back, with nouns and measures of the reply it points to."""
    head = reply.substr(1, 500)
    nouns = F.slice(F.filter(F.regexp_extract_all(head, F.lit(noun), 0), lambda v: ~v.isin(GENERIC)), 1, 5)
    extra = F.concat(nouns, F.slice(F.regexp_extract_all(head, F.lit(MEASURE), 0), 1, 3))
    points = message.rlike("|".join(pointers or POINTERS)) & reply.isNotNull() & (F.size(extra) > 0)
    return F.when(points, F.concat(message, F.lit(" "), F.array_join(extra, " "))).otherwise(message)


# The numbered works that a question may name, and phrases of questions that name nothing.
WORKS = r"(?:开发复垦|整治地块)\s*\d+#?"
ASKING = "什么是 怎么样 有没有 是不是 能不能 请问下 帮我看 请问你 帮我查 告诉我 有哪些 是什么 怎么做 为什么 可以吗 是否有 多少个 主要有".split()


def query_entities(message: Column, most: int = 8) -> Column:
    """Names that a question may mean, where no index of names is at hand: numbered works, then runs of three to ten characters."""
    nouns = F.filter(F.regexp_extract_all(message, F.lit("[一-龥]{3,10}"), 0), lambda v: ~v.isin(ASKING))
    return F.slice(F.concat(F.regexp_extract_all(message, F.lit(WORKS), 0), nouns), 1, most)


def form_fields(text: Column, fields: dict[str, str] | None = None) -> Column:
    """Names of the form fields that a chunk gives evidence of."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in (fields or FIELDS).items()]))


PENALTY = "company_name string, credit_code string, penalty_type string, legal_basis string, fine_amount_yuan double"


def valid_record(text: Column, kinds: tuple[str, ...] = ("罚款", "警告", "暂扣", "吊销")) -> tuple[Column, Column]:
    """(record, is it valid) of a JSON penalty record; failures can be put aside."""
    r = F.from_json(text, PENALTY)
    ok = r["company_name"].isNotNull() & r["credit_code"].rlike("^[0-9A-Z]{18}$") & r["penalty_type"].isin(*kinds) & r["legal_basis"].isNotNull()
    return r.withField("fine_amount_yuan", F.coalesce(r["fine_amount_yuan"], F.lit(0.0))), F.coalesce(ok, F.lit(False))


SLOTS = "array<struct<old:string,new:string,type:string>>"
# What stands for a new value and a type that an answer leaves out.
SLOT_MISSING, SLOT_UNKNOWN = "[待补充]", "未知"


def slots(text: Column) -> Column:
    """Array of (old, new, type) from the JSON of a slot answer, {"slots": [...]} or a bare list, out of thoughts and code
    fences; slots without an old or a new value are left out, a missing type is unknown. An answer that is no JSON gives none."""
    from brindle.functions.text import json_body

    body = json_body(text)
    inner = F.coalesce(F.from_json(body, f"struct<slots:{SLOTS}>")["slots"], F.from_json(F.when(body.startswith("["), body), SLOTS), F.array().cast(SLOTS))
    tidy = F.transform(inner, lambda s: F.struct(F.trim(s["old"]).alias("old"), F.trim(s["new"]).alias("new"), F.coalesce(s["type"], F.lit(SLOT_UNKNOWN)).alias("type")))
    return F.filter(tidy, lambda s: (F.coalesce(s["old"], F.lit("")) != "") & s["new"].isNotNull())


def filled(text: Column, found: Column) -> Column:
    """A text with the old value of each slot replaced by the new one, in order."""
    return F.aggregate(found, text, lambda acc, s: F.replace(acc, s["old"], F.coalesce(s["new"], F.lit(SLOT_MISSING))))


# What is asked where a form gives no words.
FORM_QUESTION = "表格填写背景资料与事实信息"


def table_words(html: Column, most: int = 30) -> Column:
    """Words to look up for filling a form, each once: cells of 2 to 99 characters, then what stands before a colon (：) in
    paragraphs and spans, 2 to 19 characters; underscores are blanks to fill in."""
    bare = lambda c: F.regexp_replace(c, "<[^>]+>", "")
    cells = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:td|th)[^>]*>(.*?)</(?:td|th)>"), 1), lambda c: F.trim(F.regexp_replace(bare(c), r"[_＿\s]+", " ")))
    cells = F.filter(cells, lambda w: F.length(w).between(2, 99))
    lines = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:p|span)[^>]*>(.*?)</(?:p|span)>"), 1), lambda c: F.trim(F.regexp_replace(bare(c), "[_＿]+", "")))
    labels = F.transform(F.filter(lines, lambda c: c.contains("：")), lambda c: F.trim(F.substring_index(c, "：", 1)))
    return F.slice(F.array_distinct(F.concat(cells, F.filter(labels, lambda w: F.length(w).between(2, 19)))), 1, most)


def form_question(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(FORM_QUESTION)


def judged(score: Column) -> Column:
    """A judge's score within 0 and 1; a half where it is not a number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.try_cast("double"), F.lit(0.5))))


def judged_documents(column: Column) -> Column:
    """A JSON list of documents, or the raw string as the only one."""
    found = F.from_json(column, "array<string>")
    return F.when(column.rlike(r"^\s*\["), F.coalesce(found, F.array(column))).otherwise(F.array(column))


# Codes that stand in cells: stations, and words of letters and digits of 4 to 20 characters.
CELL_CODE = r"[a-zA-Z]?\d+\+\d+(?:\.\d+)?|(?=[a-zA-Z0-9_-]*[a-zA-Z])(?=[a-zA-Z0-9_-]*\d)[a-zA-Z0-9_-]{4,20}"


def cell_codes(cells: Column, most: int = 50) -> Column:
    """Distinct codes of a table's cells, in order, to search it by."""
    codes = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CELL_CODE), 0)))
    return F.slice(F.array_distinct(codes), 1, most)


def instant(text: Column) -> Column:
    """A time stamp of an ISO text: with Z or an offset that moment, without one as it stands in the session's zone; null if it is none."""
    return text.try_cast("timestamp")


def in_zone(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """What the clock of a zone shows at a moment."""
    return F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone)
