"""Values of one kind that differ between chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Patterns of the values, and the labels of the kinds of dates.
MONEY = (r"(\d+(?:\.\d+)?\s*万元)", r"(\d+(?:\.\d+)?\s*元)", r"(¥\s*\d+(?:\.\d+)?)", r"(人民币\s*\d+(?:\.\d+)?\s*元?)")
RATIO = (r"(\d+\.?\d*%)", r"(\d+)\s*%")
COMPANY = (r"([^\s]{4,}公司)", r"([^\s]{2,}贸易)", r"([^\s]{2,}科技)")
DATES = (
    ("签订/生效日期", r"\d{4}年\d{1,2}月\d{1,2}日"),
    ("签订/生效日期", r"\d{4}-\d{2}-\d{2}"),
    ("签订/生效日期", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("年月", r"\d{4}年\d{1,2}月"),
    ("年月", r"\d{4}-\d{2}"),
    ("年份", r"\d{4}年"),
)
#: What every match of a pattern has in it; a text without that isn't searched, which can take the square of its length.
_SIGNS = {p: next(s for s in ("万元", "人民币", "元", "¥", "%", "公司", "贸易", "科技", "年", "-", "/") if s in p) for p in (*MONEY, *RATIO, *COMPANY, *(f"({p})" for _, p in DATES))}


def _matches(pattern: str) -> Column:
    got = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    return F.when(F.contains("content", F.lit(_SIGNS[pattern])), got).otherwise(F.array().cast("array<string>")) if pattern in _SIGNS else got


def values(chunks: DataFrame, patterns: tuple[str, ...], least: int, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """kind, value, chunk_id, source_file of every match, with the columns of ``by``."""
    found = F.flatten(F.array(*map(_matches, patterns)))
    rows = chunks.select(*by, "chunk_id", "source_file", F.explode(found).alias("value")).withColumn("value", strip(F.col("value")))
    return rows.where(F.length("value") >= least).select(*by, F.lit(kind).alias("kind"), "value", "chunk_id", "source_file")


def _reported(rows: DataFrame, by: Sequence[str] = (), chunk_count: int = 0, most: int | None = None) -> DataFrame:
    """kind, value, n, chunks of kinds with two values at least and so many chunks; a chunk comes once a match."""
    keys, found = [*by, "kind"], F.array_sort(F.collect_list("chunk_id"))
    per = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), found.alias("ids"))
    if by:  # the values of one answer are few, and come from one pass over its texts
        w = Window.partitionBy(*keys)
        per = per.withColumn("v", F.count(F.lit(1)).over(w))
        if chunk_count:
            per = per.withColumn("c", F.size(F.array_distinct(F.flatten(F.collect_list("ids").over(w)))))
    else:
        whole = rows.groupBy(*keys).agg(F.count_distinct("value").alias("v"), F.count_distinct("chunk_id").alias("c"))
    ok = F.col("v") >= 2
    if chunk_count:
        ok = ok & (F.col("c") >= chunk_count)
    if most is not None:
        ok = ok & (F.col("v") <= most)
    per = per.where(ok) if by else per.join(whole.where(ok).select(*keys), keys, "left_semi")
    return per.select(*by, "kind", "value", "n", F.array_join("ids", ",").alias("chunks"))


# each of these takes the chunks of one answer, or of many, told apart by the columns of ``by``


def money(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _reported(values(chunks, MONEY, 2, "金额", by), by)


def dates(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = None
    for label in dict.fromkeys(label for label, _ in DATES):
        one = values(chunks, tuple(f"({p})" for name, p in DATES if name == label), 4, f"日期({label})", by)
        rows = one if rows is None else rows.unionByName(one)
    return _reported(rows, by, chunk_count=2)


def ratios(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Up to six values, and only between two files at least."""
    files = chunks.where("coalesce(source_file, '') != ''").groupBy(*by).agg(F.count_distinct("source_file").alias("f")).where("f >= 2").drop("f")
    got = _reported(values(chunks, RATIO, 2, "比例", by), by, most=6)
    return got.join(files, list(by), "left_semi") if by else got.crossJoin(F.broadcast(files))  # one row, or none


def companies(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _reported(values(chunks, COMPANY, 4, "公司名", by), by)


def annotate(chunks: DataFrame, conflicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """chunk_id, whether it takes part in a conflict, and the kinds it does."""
    hits = conflicts.select(*by, "kind", F.explode(F.split("chunks", ",")).alias("chunk_id")).groupBy(*by, "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return chunks.select(*by, "chunk_id").join(hits.hint("merge"), [*by, "chunk_id"], "left").select(*by, "chunk_id", F.col("kinds").isNotNull().alias("has_conflict"), F.coalesce("kinds", F.lit("")).alias("kinds"))
