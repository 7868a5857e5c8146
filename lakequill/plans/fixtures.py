"""Cases that the tables don't have, as text and sheets: for each customer a variation, so that queries grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt

_SQL = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "chunks": (
        "chunk_id string, source_file string, content string",
        [
            ("a_0", "a.pdf", "甲方：北京星海科技有限公司，合同金额为500万元，签订日期2024年1月15日。"),
            ("a_1", "a.pdf", "首付款30%，验收后支付50%，质保金20%。人民币500万元整。"),
            ("a_2", "a.pdf", "有效期自2024-01-15至2025-01-14，共12个月。"),
            ("b_0", "b.docx", "甲方：北京星海科技有限公司，合同总价480万元，签订日期2024年3月1日。"),
            ("b_1", "b.docx", "首付款40%，余款60%。乙方为上海远航贸易有限公司 。"),
            ("b_2", "b.docx", "无关内容，没有数字。"),
        ],
    ),
    "cases": (
        "id bigint, query string, answer string, context string, truth string",
        [
            (1, "合同 金额 是多少", "合同 金额 为500万元，由甲方支付。", "甲方与乙方签订合同，合同金额为500万元，付款分三期。", "合同金额为500万元"),
            (2, "付款 方式 是什么", "首付款30%，验收后支付50%，质保金20%。\n余款一次结清给乙方公司。", "付款方式：首付款30%，验收后50%，质保金20%。", "首付款30%，验收后50%，质保金20%"),
            (3, "有效期多长", "无法回答该问题", "合同有效期一年。", "一年"),
            (4, "谁是乙方", "短", "乙方是上海远航贸易有限公司。", "上海远航贸易有限公司"),
            (5, "delivery date", "The delivery date is 2024 and the buyer pays 20 percent. Nothing else。", "Delivery date 2024, 20 percent now", None),
            (6, "天气如何", "今天天气晴朗适合出门散步。", "完全无关的内容在这里出现。", ""),
        ],
    ),
    "hits": (
        "id string, answer string, expected string, n_sources bigint, confidence double",
        [("h1", "合同金额为500万元", "合同,500万元,金额", 2, 0.9), ("h2", "不清楚", "付款,30%", 0, -1.0), ("h3", "首付款30%，余款70%", "首付款,30%,余款,违约金", 1, 0.0)],
    ),
    "texts": (
        "id bigint, t string",
        [
            (1, "第一章 总则\n一、目的\n1、适用范围\n（一）定义\n1.条款内容\n1.5倍工资\n普通一行"),
            (2, "first line\n \t \nsecond hyphen-\nated line\n\n\n\n- 12 -\n  7  \nlast"),
            (3, "— 3 —\n正文\n\n\n正文二\n4"),
            (4, "# 标题甲\n第一段\n## 标题乙\n第二段"),
            (5, ""),
            (6, None),
        ],
    ),
    "images": (
        "doc bigint, pos bigint, kind string, content string",
        [(1, 0, "text", "前文一二三"), (1, 1, "image", "fig1"), (1, 2, "image", "fig2"), (1, 3, "text", "后文四五六"), (2, 0, "image", "fig3"), (2, 1, "text", "only after")],
    ),
    "pdf_pages": (
        "page_no bigint, text string, has_table boolean, img_w bigint, img_h bigint",
        [(1, "x" * 60, False, 0, 0), (2, "short", True, 0, 0), (3, "short", False, 500, 450), (4, "short", False, 500, 300), (5, "   " + "y" * 49 + "  ", False, 0, 0), (6, "", False, 0, 0)],
    ),
    "pdf_blocks": ("page bigint, pos bigint, block string", [(1, 0, "这是第\n一行"), (1, 1, "english line\nnext line"), (1, 2, "\n\n"), (1, 3, "金额：\n100 元"), (2, 0, "单独一块")]),
    "answers": ("id bigint, t string", [(1, "问题：金额？\n回答：合同金额为500万元。\n来源：a.pdf"), (2, "合同有效期一年\n要求：简洁"), (3, "回答: 三期付款\n\n首付30%")]),
    "numbers": ("n string", [(x,) for x in ("一", "两", "十", "十二", "二十", "三十五", "一百", "一百零五", "一百二十五", "九百九十九", "7", "042", "abc", "零", "")]),
    "refs": ("ref string", [(x,) for x in ("A1", "b12", "AA3", "XFD1048576", "第3行第4列", "5,6", "7 , 8", "junk", "")]),
    "units": ("v string", [(x,) for x in ("1,234.5万元", "56（预计）亿元", "78%", "12人", "3.5 (est)", "北京", "9,000", "100 元")]),
    "colours": ("c string", [(x,) for x in ("rgb(255, 0, 16)", "red", "Yellow", "绿色", "none", "rgb(1,2,3)")]),
    "replies": ("id bigint, t string", [(1, '<think>{"a":1}</think>```json\n{"logic":"or","groups":[{"x":{"y":1}}]}\n```'), (2, "no json"), (3, 'text {"a": 1} and {"b": 2}'), (4, '{"open": 1')]),
    "paragraphs": (
        "doc_id bigint, ordinal bigint, text string, style string, bold boolean",
        [
            (1, 0, "关于加强管理的通知", "Normal", True), (1, 1, "——某部门文件", "Normal", False), (1, 2, "作者：王某某同志撰写", "Normal", False), (1, 3, "第一段正文内容比较长，超过十五个字符才算正文段落。", "Normal", False),
            (1, 4, "小标题", "Normal", False), (1, 5, "第二段正文同样比较长，其中包含关键词预算与决算的说明。", "Normal", False), (1, 6, "", "Normal", False), (1, 7, "这是加粗的一个短句子用作标题使用", "Normal", True),
            (1, 8, "第三段正文继续说明各项工作的安排，预算执行情况见附件。", "Normal", False), (1, 9, "附件", "Heading 1", False), (1, 10, "结束语", "Normal", False),
            (2, 0, "title line", "Title", False), (2, 1, "second line", None, None), (2, 2, "A body paragraph that is long enough to count as body text.", "Normal", False), (2, 3, "end", "Normal", False),
        ],
    ),
    "sheet": (
        "sheet string, row bigint, col bigint, value string",
        [("s1", 1, 1, "报表"), ("s1", 2, 1, "国家"), ("s1", 2, 2, "人口"), ("s1", 2, 3, "GDP"), ("s1", 3, 1, "中国"), ("s1", 3, 2, "1400"), ("s1", 3, 3, ""), ("s1", 4, 1, "法国"), ("s1", 4, 2, "67"), ("s1", 4, 3, "3000"), ("s2", 1, 1, "a"), ("s2", 1, 2, "b"), ("s2", 1, 3, "c"), ("s2", 1, 4, None)],
    ),
    "edits": ("sheet string, row bigint, col bigint, value string", [("s1", 3, 3, "18000"), ("s1", 5, 1, "德国"), ("s2", 1, 1, "A")]),
    "fields": ("field string", [(x,) for x in ("国家", "GDP", "总人口", "nation_key", "Region Name", "missing")]),
    "headers": ("ord bigint, name string", [(0, "N_NationKey"), (1, "region name"), (2, "人口"), (3, "gdp"), (4, "国家/地区")]),
    "labels_t": ("ordinal bigint, text string", [(1, "甲方："), (2, "合同金额"), (3, "签订日期: "), (4, "其他内容")]),
    "label_values": ("field string, value string", [("甲方", "星海公司"), ("合同金额", "500万元"), ("签订日期", "2024-01-15"), ("金额", "x")]),
    "templates": ("id bigint, t string", [(1, "合同编号{{ 编号 }}，甲方{{甲方}}，乙方{{乙方}}，再次{{甲方}}"), (2, "no fields"), (3, "{{a}}{{b}}{{}}")]),
    "kv": ("id bigint, t string", [(1, "国家：中国\n总人口：1,400人\n无关行\nGDP（亿元）: 18,000亿元"), (2, "国家: 法国\nGDP：3,000亿元"), (3, "nothing here")]),
    "people": ("ord bigint, name string, city string, age string", [(1, "甲", "北京", ""), (2, "甲", "北京", "30"), (3, "乙", "", ""), (4, "", "上海", ""), (5, "", "", ""), (6, "乙", None, None), (7, "甲", "广州", "31")]),
    "slots": ("tbl bigint, row bigint, is_empty boolean", [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)]),
    "slot_values": ("tbl bigint, place bigint, value string", [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "e"), (2, 2, "f")]),
    "tasks": ("task_id string, file_id bigint, status string", [("t1", 1, "pending"), ("t2", 2, "done"), ("t3", 3, "processing"), ("t4", 3, "failed"), ("t5", 9, "pending")]),
    "scored": ("id string, vector_score double, bm25_score double, n_tokens bigint", [("c1", 0.93, 1.0, 6), ("c2", 0.5, 5.0, 6), ("c3", 0.1, 0.0, 6), ("c4", 0.7, 2.5, 6)]),
    "items": (
        "doc bigint, pos bigint, kind string, text string",
        [(1, 0, "paragraph", "引言"), (1, 1, "paragraph", "说明一"), (1, 2, "table", ""), (1, 3, "paragraph", "说明二"), (1, 4, "paragraph", ""), (1, 5, "table", ""), (1, 6, "table", ""), *[(2, k, "paragraph", f"p{k}") for k in range(8)], (2, 8, "table", "")],
    ),
    "runs": ("para bigint, run bigint, t string", [(1, 0, "编号{{"), (1, 1, "编号}"), (1, 2, "}，甲方"), (2, 0, "没有"), (2, 1, "字段"), (3, 0, "{{甲方}}")]),
    "formats": ("row bigint, col bigint, bold string, bold_new string, color string, color_new string", [(1, 1, "0", "1", None, "FF0000"), (1, 2, "1", "1", None, None), (2, 1, "0", "0", "00FF00", "00FF00"), (3, 1, "0", "1", "a", "a")]),
    "grid_headers": ("col bigint, header string", [(1, "国家名称"), (2, "GDP"), (3, "备注")]),
    "grid_fields": ("ord bigint, field string, values string", [(1, "国家", "中国,法国"), (2, "gdp总量", "18000,3000,1"), (3, "国家名称", "x")]),
    "positions": ("p string, n bigint", [("3", 5), ("9", 5), ("0", 5), ("最后", 5), ("", 5)]),
    "cache": ("key string, file_ids string, used_at double, expire_at double", [("a", "1,2", 10.0, 100.0), ("b", "", 20.0, 50.0), ("c", "2", 30.0, 200.0), ("d", "12", 5.0, 300.0)]),
    "questions": ("id bigint, q string", [(1, "合同金额是多少"), (2, "有效期到什么时间"), (3, "甲方是谁"), (4, "天气如何"), (5, "甲方支付的费用日期")]),
    "steps": ("id bigint, done bigint, total bigint", [(1, 0, 10), (2, 5, 10), (3, 10, 10), (4, 20, 10), (5, 3, 0)]),
    "uploads": ("file_id bigint, name string, size bigint", [(1, "报告.pdf", 100), (2, "../x/数据.XLSX", 60000000), (3, "a\\b.exe", 5), (4, "noext", 1), (5, "c.md", 52428800)]),
}


#: How a case varies from customer to customer: keys get the customer's, digits and scores change, all else stays.
VARIED: dict[str, dict[str, str]] = {
    "chunks": {"chunk_id": "key", "source_file": "key", "content": "digits"}, "cases": {"id": "key", "answer": "digits", "context": "digits", "truth": "digits"}, "hits": {"id": "key", "answer": "digits"},
    "texts": {"id": "key", "t": "digits"}, "images": {"doc": "key", "content": "key"}, "pdf_pages": {"page_no": "key", "img_w": "scale", "img_h": "scale"}, "pdf_blocks": {"page": "key", "block": "digits"}, "answers": {"id": "key", "t": "digits"},
    "numbers": {"n": "digits"}, "refs": {"ref": "digits"}, "units": {"v": "digits"}, "colours": {"c": "ones"}, "replies": {"id": "key", "t": "digits"}, "paragraphs": {"doc_id": "key"}, "sheet": {"sheet": "key", "value": "digits"},
    "edits": {"sheet": "key", "value": "digits"}, "headers": {"name": "key"}, "fields": {"field": "key"}, "labels_t": {"ordinal": "key"}, "templates": {"id": "key", "t": "digits"}, "kv": {"id": "key", "t": "digits"}, "people": {"ord": "key", "name": "key"},
    "slots": {"tbl": "key"}, "slot_values": {"tbl": "key", "value": "key"}, "tasks": {"task_id": "key", "file_id": "key"}, "scored": {"id": "key", "vector_score": "scale", "bm25_score": "scale"}, "items": {"doc": "key", "text": "key"},
    "runs": {"para": "key"}, "formats": {"row": "key"}, "grid_headers": {"header": "key"}, "grid_fields": {"field": "key", "values": "digits"}, "positions": {"n": "scale"}, "cache": {"key": "key", "used_at": "scale", "expire_at": "scale"},
    "questions": {"id": "key"}, "steps": {"id": "key", "total": "scale"}, "uploads": {"file_id": "key", "size": "scale"},
}
#: Rows of one customer are apart from those of others in whole keys.
APART = 100


def spread(spark: SparkSession, sf_dir: str, name: str, group: bool = False) -> DataFrame:
    """A case's rows for each customer, varied; with the customer's key as ``g`` if asked."""
    if name not in VARIED:
        return inline(spark, name)
    ddl, rows = TABLES[name]
    kinds = [c.split() for c in ddl.split(", ")]
    cases = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(r, kinds)]) for r in rows])
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("g"))
    got = dealt(keys, "g").select("g", F.inline(cases))
    out = []
    for c, kind in kinds:
        rule, v, g = VARIED[name].get(c), F.col(c), F.col("g")
        if rule == "key":
            v = g * APART + v if kind == "bigint" else F.when(v != "", F.concat(v, F.lit("_"), g.cast("string"))).otherwise(v)
        elif rule == "digits":
            v = F.replace(F.replace(v, F.lit("5"), (g % 9 + 1).cast("string")), F.lit("1"), (g % 7 + 1).cast("string"))
        elif rule == "ones":
            v = F.replace(v, F.lit("1"), (g % 9 + 1).cast("string"))
        elif rule == "scale":
            v = v + (g % 50) * (v / 100 if kind == "double" else v % 7)
        out.append(v.cast(kind).alias(c))
    return got.select(*out, *(["g"] if group else []))


def inline(spark: SparkSession, name: str) -> DataFrame:
    """A case's rows as they are: what a user states beside a table."""
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def stated(name: str) -> str:
    """``inline`` as a SQL subquery."""
    ddl, rows = TABLES[name]
    columns = [c.split() for c in ddl.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    picked = ", ".join(f"CAST({c} AS {_SQL[t]}) AS {c}" for c, t in columns)
    return f"(SELECT {picked} FROM (VALUES {body}) AS v({', '.join(c for c, _ in columns)}))"


def values(name: str, group: bool = False) -> str:
    """``spread`` as a SQL subquery."""
    if name not in VARIED:
        return stated(name)
    out = []
    for c, kind in (c.split() for c in TABLES[name][0].split(", ")):
        rule, v = VARIED[name].get(c), f"x.{c}"
        if rule == "key":
            v = f"g * {APART} + {v}" if kind == "bigint" else f"CASE WHEN {v} <> '' THEN {v} || '_' || g ELSE {v} END"
        elif rule == "digits":
            v = f"replace(replace({v}, '5', CAST(g % 9 + 1 AS VARCHAR)), '1', CAST(g % 7 + 1 AS VARCHAR))"
        elif rule == "ones":
            v = f"replace({v}, '1', CAST(g % 9 + 1 AS VARCHAR))"
        elif rule == "scale":
            v = f"{v} + (g % 50) * ({v} / 100)" if kind == "double" else f"{v} + (g % 50) * ({v} % 7)"
        out.append(f"CAST({v} AS {_SQL[kind]}) AS {c}")
    return f"(SELECT {', '.join(out)}{', g' if group else ''} FROM {stated(name)} x CROSS JOIN (SELECT CAST(c_custkey AS BIGINT) AS g FROM customer))"
