"""Plain-language edit commands as operations, by rules; a model's reading may be merged in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed words of the commands: operation and what it is recognised by.
RULES: list[tuple[str, str]] = [
    ("delete_paragraph", r"(删除|去掉|移除).*(段|段落)"), ("edit_paragraph", r"(修改|改为|改成|替换).*(段|段落)"), ("add_paragraph", r"(添加|插入|新增|加).*(段|段落)"),
    ("delete_heading", r"(删除|去掉).*标题"), ("edit_heading", r"(修改|改为|改成).*标题"), ("replace_text", r"(把|将).*(替换|换)(为|成)"),
    ("delete_row", r"(删除|去掉).*行"), ("add_row", r"(添加|插入|新增).*行"), ("delete_column", r"(删除|去掉).*列"), ("add_column", r"(添加|插入|新增).*列"),
    ("conditional_delete", r"(删除|去掉).*(大于|小于|等于|包含|为空)"), ("conditional_filter", r"(筛选|过滤|找出).*(大于|小于|等于|包含|为空)"), ("conditional_format", r"(标红|标记|高亮|标黄).*(大于|小于|等于|包含)|(大于|小于|等于|包含).*(标红|标记|高亮|标黄)"),
    ("edit_cell", r"[A-Z]+[0-9]+.*(改为|改成|设为|填)"), ("extract_content", r"(提取|抽取|读取)"), ("generate_summary", r"(总结|摘要|概括)"), ("format", r"(加粗|斜体|下划线|字号|字体|颜色)"), ("search", r"(查找|搜索)"),
]
_COMPARE = (("大于等于", ">="), ("小于等于", "<="), ("大于", ">"), ("小于", "<"), ("不等于", "!="), ("等于", "=="))


@dataclass
class Operation:
    kind: str
    confidence: float
    parameters: dict = field(default_factory=dict)
    instruction: str = ""


def parse(text: str) -> Operation:
    """The rule with the longest match; its score grows with what it has read of the command."""
    best, score = "unknown", 0.0
    for kind, pattern in RULES:
        m = re.search(pattern, text)
        if m:
            got = min(0.95, 0.5 + len(m[0]) / 40 + (0.1 if kind.startswith("conditional") else 0.0))
            if got > score:
                best, score = kind, got
    p: dict = {}
    if m := re.search(r"第([0-9一二三四五六七八九十百两]+)(段|行|列|个)", text):
        p["position"] = f"第{m[1]}{m[2]}"
    elif re.search("最后", text):
        p["position"] = "最后一段"
    if m := re.search(r"([A-Z]+[0-9]+)", text):
        p["cell"] = m[1]
    if m := re.search(r"(?:把|将)[“\"]?(.+?)[”\"]?(?:替换|换)(?:为|成)[“\"]?(.+?)[”\"]?$", text):
        p["old"], p["new"] = m[1], m[2]
    elif m := re.search(r"(?:改为|改成|设为|内容为|内容是)[：:“\"]?(.+?)[”\"]?$", text):
        p["value"] = m[1]
    for word, sign in _COMPARE:
        if m := re.search(rf"([^\s，,]{{1,12}}?)(?:列)?{word}\s*(-?\d+(?:\.\d+)?)", text):
            p["column"], p["condition"] = re.sub("^(筛选|过滤|删除|找出|把|将|标红|高亮|去掉)", "", m[1]), f"{sign}{m[2]}"
            break
    else:
        if m := re.search(r"([^\s，,]{1,12}?)(?:列)?包含([^\s，,的]+)", text):
            p["column"], p["condition"] = re.sub("^(筛选|过滤|删除|找出|把|将|去掉)", "", m[1]), f"contains:{m[2]}"
    if "加粗" in text:
        p["bold"] = True
    if m := re.search(r"(红|绿|蓝|黄|黑|白)色?", text):
        p["color"] = {"红": "FF0000", "绿": "00FF00", "蓝": "0000FF", "黄": "FFFF00", "黑": "000000", "白": "FFFFFF"}[m[1]]
    return Operation(best, round(score, 3), p, text)


def merge(rule: Operation, model: Operation | None) -> Operation:
    """The reading of higher confidence, with the parameters of both; those of the better one win."""
    if model is None:
        return rule
    a, b = (rule, model) if rule.confidence >= model.confidence else (model, rule)
    return Operation(a.kind, a.confidence, {**b.parameters, **a.parameters}, a.instruction)
