"""Row conditions over tables: a small condition tree, a mini-language for cells, and plain-language rules.

A condition is ``{"col", "op", "v1", "v2"}``; groups of conditions are ANDed, the groups ORed. Values compare as text
for equality and containment and as numbers or dates for ranges. All of it becomes one boolean Column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_text

DATE = re.compile(r"\d{4}[-/]\d{1,2}([-/]\d{1,2})?( \d{1,2}:\d{2}(:\d{2})?)?")
_FORMATS = ("yyyy-M-d HH:mm:ss", "yyyy-M-d HH:mm", "yyyy-M-d", "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "yyyy/M/d")


def resolve(df: DataFrame, name: str) -> str | None:
    """The column of that name, or the first that contains it or is contained in it."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if name in c or c in name), None)


def number(c: Column) -> Column:
    return c.cast("string").try_cast("double") if c is not None else c


def moment(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS], text.try_cast("timestamp"))


def _float(v: str) -> float | None:
    try:
        return float(str(v).replace(",", ""))
    except ValueError:
        return None


def condition(df: DataFrame, cond: dict, on_missing: str = "pass") -> Column:
    """One condition as a Column that is never null. A column or number that can't be found passes all rows, or raises."""
    name = resolve(df, cond["col"])
    if name is None:
        if on_missing == "error":
            raise KeyError(cond["col"])
        return F.lit(True)
    c, op, v1, v2 = F.col(f"`{name}`"), cond["op"], str(cond.get("v1", "")), str(cond.get("v2", ""))
    text = as_text(c)
    if op in ("eq", "neq"):
        return (text == v1) if op == "eq" else (text != v1)
    if op in ("contains", "not_contains"):
        found = F.contains(F.coalesce(c.cast("string"), F.lit("")), F.lit(v1))
        return found if op == "contains" else ~found
    if op in ("empty", "not_empty"):
        return (text == "") if op == "empty" else (text != "")
    if op == "between" and DATE.fullmatch(v1) and DATE.fullmatch(v2):
        return F.coalesce(moment(c).between(moment(F.lit(v1)), moment(F.lit(v2))), F.lit(False))
    low, high = _float(v1), _float(v2)
    if op not in ("gt", "lt", "gte", "lte", "between") or low is None or op == "between" and high is None:
        if on_missing == "error":
            raise ValueError(cond)
        return F.lit(True)
    x = number(c)
    got = {"gt": x > low, "lt": x < low, "gte": x >= low, "lte": x <= low, "between": x.between(low, high) if high is not None else None}[op]
    return F.coalesce(got, F.lit(False))


def any_of(df: DataFrame, groups: Sequence[Sequence[dict]], on_missing: str = "pass") -> Column:
    """OR of ANDs; no groups, or an empty one, pass all rows."""
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [condition(df, c, on_missing) for c in g], F.lit(True)) for g in groups])


def fuzzy_time(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose text equals the value; if there are none, those that share its first 16 characters (10 at least)."""
    text = as_text(F.col(name))
    exact = text == value
    if len(value) < 10:
        return df.where(exact)
    hit = df.agg(F.coalesce(F.max(exact.cast("int")), F.lit(0)).alias("__hit"))
    return df.crossJoin(F.broadcast(hit)).where(F.when(F.col("__hit") == 1, exact).otherwise(F.startswith(text, F.lit(value[:16])))).drop("__hit")


# plain language

_PAIRS = (("不等于", "neq"), ("不是", "neq"), ("不包含", "not_contains"), ("大于等于", "gte"), ("小于等于", "lte"), (">=", "gte"), ("<=", "lte"), ("!=", "neq"), ("大于", "gt"), ("小于", "lt"), ("等于", "eq"), ("包含", "contains"), ("含有", "contains"), (">", "gt"), ("<", "lt"), ("==", "eq"), ("=", "eq"), ("是", "eq"), ("为", "eq"))
_RANGE = re.compile(r"^(.+?)(?:从|在)(.+?)(?:到|至)(.+?)(?:之间)?$")


def parse_rules(text: str) -> list[dict] | None:
    """Conditions of a sentence such as ``金额大于1000且状态不是取消``; None if a part isn't understood."""
    out = []
    for part in re.split(r"[，,]|并且|且", text.strip()):
        part = re.sub(r"^(只要|仅|筛选|过滤|选择|保留)", "", part.strip())
        if not part:
            continue
        m = _RANGE.match(part)
        if m and (DATE.fullmatch(m[2].strip()) or _float(m[2]) is not None):
            out.append({"col": m[1].strip(), "op": "between", "v1": m[2].strip(), "v2": m[3].strip()})
            continue
        best = None
        for word, op in _PAIRS:  # the earliest operator, the longest of those
            at = part.find(word)
            if at > 0 and (best is None or at < best[0] or at == best[0] and len(word) > len(best[1])):
                best = (at, word, op)
        if best is None:
            return None
        at, word, op = best
        out.append({"col": part[:at].strip(), "op": op, "v1": part[at + len(word) :].strip().rstrip("的"), "v2": ""})
    return out or None


def include_exclude(df: DataFrame, text: str) -> DataFrame | None:
    """``只要X是Y`` keeps, ``不要A和B`` drops rows with these words in a text column; None if it removes no row."""
    keep = re.search(r"(?:只要|只有|仅)(.+?)(?:的|不要|，|$)", text)
    drop = re.search(r"不要(.+?)(?:的|$)", text)
    cond = F.lit(True)
    if keep and (m := re.match(r"(.{1,10}?)(?:是|为|等于)(.+)", keep[1])):
        name, value = resolve(df, m[1].strip()), m[2].strip().rstrip("的")
        columns = [name] if name else df.columns
        cond = reduce(lambda a, b: a | b, [as_text(F.col(f"`{c}`")) == value for c in columns])
    if drop:
        words = [w.strip() for w in re.split(r"[和、,，]", drop[1]) if len(w.strip()) >= 2]
        texts = [c for c, t in df.dtypes if t == "string"]
        for w in words:
            for c in texts:
                cond = cond & ~F.contains(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(w))
    # a single probe that stops at the first row that the rule removes
    return df.where(cond) if df.where(~cond).limit(1).count() else None


def parse_cell_condition(text: str):
    """``>90``, ``<=60``, ``==100``, ``contains:kw``, ``empty``, ``not_empty`` as a function of a cell Column."""
    text = text.strip()
    if text == "empty":
        return lambda c: as_text(c) == ""
    if text == "not_empty":
        return lambda c: as_text(c) != ""
    if text.startswith("contains:"):
        return lambda c: F.contains(F.coalesce(c.cast("string"), F.lit("")), F.lit(text[9:]))
    m = re.match(r"^(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?)$", text)
    if not m:
        return lambda c: F.lit(False)
    v = float(m[2])
    compare = {">": lambda x: x > v, ">=": lambda x: x >= v, "<": lambda x: x < v, "<=": lambda x: x <= v, "==": lambda x: x == v, "!=": lambda x: x != v}[m[1]]
    return lambda c: F.coalesce(compare(number(c)), F.lit(False))


def resolve_column(df: DataFrame, ref: str) -> str | None:
    """A header that contains ref, else a 1-based number, else spreadsheet letters."""
    found = next((c for c in df.columns if ref in c), None)
    if found:
        return found
    k = int(ref) if ref.isdigit() else reduce(lambda a, x: a * 26 + ord(x) - 64, ref.upper(), 0) if re.fullmatch("[A-Za-z]{1,3}", ref) else 0
    return df.columns[k - 1] if 0 < k <= len(df.columns) else None


def _any_cell(df: DataFrame, column: str, cond: str) -> Column:
    test, name = parse_cell_condition(cond), resolve_column(df, column)
    return reduce(lambda a, b: a | b, [test(F.col(f"`{c}`")) for c in ([name] if name else df.columns)])


def conditional_filter(df: DataFrame, column: str, cond: str) -> DataFrame:
    """Rows with a cell that meets the condition; all columns count if the named one isn't there."""
    return df.where(_any_cell(df, column, cond))


def conditional_delete(df: DataFrame, column: str, cond: str) -> DataFrame:
    return df.where(~_any_cell(df, column, cond))


def conditional_style(cells: DataFrame, cond: str, colour: str) -> DataFrame:
    """Cells with column style set to the colour where they meet the condition."""
    return cells.withColumn("style", F.when(parse_cell_condition(cond)(F.col("value")), F.lit(colour)))


def preview(df: DataFrame, column: str, cond: str, key: str, limit: int = 50) -> DataFrame:
    """The number of rows that would change and the first of their keys."""
    hit = df.where(_any_cell(df, column, cond))
    first = hit.orderBy(key).limit(limit).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("first_keys"))
    return hit.agg(F.count(F.lit(1)).alias("n")).crossJoin(first)


def find_cells(cells: DataFrame, keyword: str) -> DataFrame:
    return cells.where(F.contains(F.coalesce(F.col("value"), F.lit("")), F.lit(keyword)))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
