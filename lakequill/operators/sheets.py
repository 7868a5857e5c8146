"""Edits of sheets as cell tables (sheet, row, col, value) and of documents as paragraph tables; each edit is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def to_cells(df: DataFrame, sheet: str, order: str, partition: str | None = None) -> DataFrame:
    """Cells of a table: row 1 holds the names, rows follow in order."""
    from .tables import with_ordinal

    rows = with_ordinal(df, order, partition)
    body = rows.select((F.col("ordinal") + 1).alias("row"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("c", "value"))
    head = df.sparkSession.createDataFrame([(1, k, c) for k, c in enumerate(df.columns)], "row bigint, c int, value string")
    return head.unionByName(body).select(F.lit(sheet).alias("sheet"), "row", (F.col("c") + 1).cast("bigint").alias("col"), "value")


def edit_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells with the values of edits (sheet, row, col, value), which may add cells."""
    e = edits.withColumnRenamed("value", "new").withColumn("set", F.lit(True))
    return cells.join(e, ["sheet", "row", "col"], "full").select("sheet", "row", "col", F.when(F.col("set"), F.col("new")).otherwise(F.col("value")).alias("value"))


def insert_row(cells: DataFrame, sheet: str, at: int, values: list[str]) -> DataFrame:
    moved = cells.withColumn("row", F.when((F.col("sheet") == sheet) & (F.col("row") >= at), F.col("row") + 1).otherwise(F.col("row")))
    new = cells.sparkSession.createDataFrame([(sheet, at, k, v) for k, v in enumerate(values, 1)], "sheet string, row bigint, col bigint, value string")
    return moved.unionByName(new)


def delete_row(cells: DataFrame, sheet: str, at: int) -> DataFrame:
    own = F.col("sheet") == sheet
    return cells.where(~(own & (F.col("row") == at))).withColumn("row", F.when(own & (F.col("row") > at), F.col("row") - 1).otherwise(F.col("row")))


def insert_column(cells: DataFrame, sheet: str, at: int, header: str) -> DataFrame:
    moved = cells.withColumn("col", F.when((F.col("sheet") == sheet) & (F.col("col") >= at), F.col("col") + 1).otherwise(F.col("col")))
    new = cells.sparkSession.createDataFrame([(sheet, 1, at, header)], "sheet string, row bigint, col bigint, value string")
    return moved.unionByName(new)


def delete_column(cells: DataFrame, sheet: str, at: int) -> DataFrame:
    own = F.col("sheet") == sheet
    return cells.where(~(own & (F.col("col") == at))).withColumn("col", F.when(own & (F.col("col") > at), F.col("col") - 1).otherwise(F.col("col")))


def extract_column(cells: DataFrame, sheet: str | None, col: int) -> DataFrame:
    """row and value of a sheet's column, or sheet, row and value of that column in all sheets."""
    own = cells.where((F.col("col") == col) & F.col("value").isNotNull())
    return own.select("sheet", "row", "value") if sheet is None else own.where(F.col("sheet") == sheet).select("row", "value")


def style_row(cells: DataFrame, sheet: str, row: int, style: dict[str, str]) -> DataFrame:
    """Adds a style as text to the cells of a row."""
    text = ";".join(f"{k}={v}" for k, v in sorted(style.items()))
    return cells.withColumn("style", F.when((F.col("sheet") == sheet) & (F.col("row") == row), F.lit(text)))


# paragraphs: doc_id, ordinal (0-based), text, style, bold


def classify(paragraphs: DataFrame) -> DataFrame:
    """Adds kind: blank, heading or body. Styles say so, or else place, dashes, labels, length and boldness do."""
    # fixed values: style names, labels, 15 and 30 characters
    t = tx.strip(F.col("text"))
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    styled = F.coalesce(F.col("style"), F.lit("")).rlike("(?i)标题|heading|subtitle|subhead|cover")
    label = t.rlike("^(撰稿|摄影|作者|日期|时间|审核|校对)[：:]")
    loose = (F.col("ordinal") <= 1) | t.rlike("^(—|――)") | label | ((F.length(t) < 15) & (F.col("ordinal") < total - 3)) | (F.coalesce(F.col("bold"), F.lit(False)) & (F.length(t) < 30))
    return paragraphs.withColumn("kind", F.when(t == "", "blank").when(styled | loose, "heading").otherwise("body"))


def numbered(paragraphs: DataFrame) -> DataFrame:
    """Adds n, the 1-based place of a paragraph within its kind."""
    w = Window.partitionBy("doc_id", "kind").orderBy("ordinal")
    return classify(paragraphs).withColumn("n", F.row_number().over(w).cast("bigint"))


def locate(paragraphs: DataFrame, reference: str, kind: str = "body") -> DataFrame:
    """The paragraph that a phrase means: 最后一段, 第N段 (digits or numerals), or the first that contains the words."""
    import re

    rows = numbered(paragraphs).where(F.col("kind") == kind)
    w = Window.partitionBy("doc_id")
    m = re.search(r"第([0-9一二三四五六七八九十百两]+)[段个]", reference)
    if re.search("最后一|末", reference):
        return rows.withColumn("__last", F.max("n").over(w)).where("n = __last").drop("__last")
    if m:
        return rows.where(F.col("n") == tx.chinese_number(F.lit(m[1])))
    if "第一" in reference or "首" in reference:
        return rows.where("n = 1")
    hit = rows.where(F.contains("text", F.lit(reference)))
    return hit.withColumn("__first", F.min("n").over(w)).where("n = __first").drop("__first")


def insert_paragraph(paragraphs: DataFrame, doc_id: int, at: int, text: str) -> DataFrame:
    moved = paragraphs.withColumn("ordinal", F.when((F.col("doc_id") == doc_id) & (F.col("ordinal") >= at), F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    new = paragraphs.sparkSession.createDataFrame([(doc_id, at, text)], "doc_id bigint, ordinal bigint, text string")
    return moved.unionByName(new, allowMissingColumns=True)


def delete_paragraph(paragraphs: DataFrame, doc_id: int, at: int) -> DataFrame:
    own = F.col("doc_id") == doc_id
    return paragraphs.where(~(own & (F.col("ordinal") == at))).withColumn("ordinal", F.when(own & (F.col("ordinal") > at), F.col("ordinal") - 1).otherwise(F.col("ordinal")))


def edit_paragraph(paragraphs: DataFrame, doc_id: int, at: int, text: str) -> DataFrame:
    return paragraphs.withColumn("text", F.when((F.col("doc_id") == doc_id) & (F.col("ordinal") == at), F.lit(text)).otherwise(F.col("text")))


def replace_text(paragraphs: DataFrame, old: str, new: str, first_only: bool = False) -> DataFrame:
    """Replaces in each paragraph, or in the first of each document that has the words; adds whether it changed."""
    has = F.contains("text", F.lit(old))
    if first_only:
        first = F.min(F.when(has, F.col("ordinal"))).over(Window.partitionBy("doc_id"))
        has = has & (F.col("ordinal") == first)
    changed = F.coalesce(has, F.lit(False))
    return paragraphs.withColumn("changed", changed).withColumn("text", F.when(F.col("changed"), F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")))


def keyword_context(df: DataFrame, key: str, text: str, keyword: str, reach: int = 200) -> DataFrame:
    """Each occurrence of a keyword with its surroundings; overlapping ones count."""
    rows = df.where(F.contains(text, F.lit(keyword))).select(key, F.col(text).alias("__t"), F.explode(tx.keyword_places(F.col(text), keyword)).alias("place"))
    start = F.greatest(F.col("place") - reach, F.lit(1))
    end = F.least(F.col("place") + len(keyword) - 1 + reach, F.length("__t"))
    part = F.concat(F.when(start > 1, "...").otherwise(""), F.substring("__t", start, end - start + 1), F.when(end < F.length("__t"), "...").otherwise(""))
    return rows.select(key, F.col("place").cast("bigint").alias("place"), part.alias("context"))


def heading_levels(line: Column) -> Column:
    """Level of a markdown line: 1 to 3 for headings, -1 for table rows, 0 otherwise."""
    return F.when(line.rlike("^# "), 1).when(line.rlike("^## "), 2).when(line.rlike("^### "), 3).when(F.startswith(line, F.lit("|")), -1).otherwise(0)
