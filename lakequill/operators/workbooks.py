"""Cells of workbooks and of document tables as chunks and as rows with names.

A sheet's rows stay together by file and sheet; no step needs more than a sheet's rows in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Rows of a chunk of lines, rows of a table that stays whole, rows of a part of a larger one, blank fields.
LINE_ROWS, WHOLE_ROWS, PART_ROWS = 20, 75, 50
BLANK_TITLE, BLANK_FIELDS = "## 空白表格模板（待填充字段）", ("姓名", "电话", "地址", "编号", "备注")


def _rows(cells: DataFrame, value: Column) -> DataFrame:
    """path, sheet, row and its cells in order (col, value), and the last row and column of the sheet."""
    # files are read and dealt out once: rows, and what holds for their sheet, come from the same groups
    filled = cells.where("sheet IS NOT NULL").select("path", "sheet", "row", "col", value.alias("value")).repartition("path", "sheet")
    rows = filled.groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    w = Window.partitionBy("path", "sheet")
    head = F.first(F.when(F.col("row") == 1, F.col("cells")), ignorenulls=True).over(w)
    rows = rows.withColumn("last", F.max("row").over(w)).withColumn("width", F.max(F.element_at("cells", -1)["col"]).over(w)).withColumn("head", head)
    return rows.where("row > 1").withColumn("head", F.map_from_entries("head"))


def line_chunks(cells: DataFrame, size: int = LINE_ROWS) -> DataFrame:
    """path, sheet, start_row, end_row, content: rows as ``name: value`` lines, size filled rows a chunk.

    The first row has the names; blank values and rows without any are left out. A chunk goes on from where the one before
    ended; the last one ends with the sheet.
    """
    # cleaned, but for lines of digits, which are page numbers in a text and values here
    rows = _rows(cells, tx.strip(F.regexp_replace(F.coalesce(F.col("value"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")))
    name = lambda c: F.coalesce(F.try_element_at("head", c["col"]), F.lit(""))
    pairs = F.transform(F.filter("cells", lambda c: c["value"] != ""), lambda c: F.concat(name(c), F.lit(": "), c["value"]))
    lines = rows.withColumn("line", F.array_join(pairs, " | ")).where("line != ''")
    w = Window.partitionBy("path", "sheet").orderBy("row")
    lines = lines.withColumn("grp", F.floor((F.row_number().over(w) - 1) / size))
    got = lines.groupBy("path", "sheet", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("own"), F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("x"))
    got = got.withColumn("end_row", F.when(F.col("n") < size, F.col("last")).otherwise(F.col("own")))
    start = F.coalesce(F.lag("end_row").over(Window.partitionBy("path", "sheet").orderBy("grp")) + 1, F.lit(2))
    got = got.withColumn("start_row", start.cast("bigint"))
    title = F.concat(F.lit("## 表格区域："), "sheet", F.lit("（第 "), F.col("start_row").cast("string"), F.lit(" 到 "), F.col("end_row").cast("string"), F.lit(" 行）\n"))
    return got.select("path", "sheet", "start_row", "end_row", F.concat(title, F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("content"))


def table_chunks(cells: DataFrame) -> DataFrame:
    """path, sheet, start_row, end_row (of the rows below the names, from 0), content: a sheet as Markdown tables.

    A sheet of WHOLE_ROWS rows at most is one chunk, a larger one has PART_ROWS rows a chunk, each below the names.
    """
    rows = _rows(cells, F.replace(F.coalesce(F.col("value"), F.lit("")), F.lit("\n"), F.lit(" ")))
    places = F.sequence(F.lit(1), F.col("width"))
    names = F.transform(places, lambda k: F.coalesce(F.try_element_at("head", k), F.concat(F.lit("Unnamed: "), (k - 1).cast("string"))))
    own = F.map_from_entries("cells")
    line = F.concat(F.lit("| "), F.array_join(F.transform(places, lambda k: F.coalesce(F.try_element_at(own, k), F.lit(""))), "|"), F.lit(" |"))
    head = F.concat(F.lit("| "), F.array_join(names, " | "), F.lit(" |\n|"), F.array_join(F.transform(places, lambda k: F.lit("---")), "|"), F.lit("|"))
    lines = rows.select("path", "sheet", (F.col("last") - 1).alias("total"), (F.col("row") - 2).alias("at"), line.alias("line"), head.alias("names"))
    per = F.when(F.col("total") <= WHOLE_ROWS, F.col("total")).otherwise(F.lit(PART_ROWS))
    got = lines.withColumn("start_row", (F.floor(F.col("at") / per) * per).cast("bigint")).withColumn("end_row", F.least(F.col("start_row") + per, F.col("total")).cast("bigint"))
    got = got.groupBy("path", "sheet", "start_row", "end_row", "total").agg(F.first("names").alias("names"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    title = F.concat(F.lit("## 表格工作簿："), "sheet", F.lit("（第"), (F.col("start_row") + 1).cast("string"), F.lit("-"), F.col("end_row").cast("string"), F.lit("行，共"), F.col("total").cast("string"), F.lit("行）\n"))
    return got.select("path", "sheet", "start_row", "end_row", F.concat_ws("\n", title, "names", F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("content"))


def numbered(chunks: DataFrame, sheets: DataFrame) -> DataFrame:
    """Chunks with their place in the file and id, sheets in the order of ``sheets`` (path, sheet, at)."""
    w = Window.partitionBy("path").orderBy("at", "start_row")
    got = chunks.join(sheets, ["path", "sheet"]).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).drop("at")
    return got.withColumn("chunk_id", F.concat("path", F.lit("_"), F.col("pos").cast("string")))


def blank_templates(files: DataFrame, cells: DataFrame) -> DataFrame:
    """path and content of the chunk that stands for a workbook without a filled row, or one that can't be read."""
    filled = cells.where("row > 1 AND trim(coalesce(value, '')) != ''").select("path").distinct()
    return files.select("path").join(filled, "path", "left_anti").select("path", F.lit(BLANK_TITLE + "\n" + " | ".join(BLANK_FIELDS)).alias("content"))


def frames(cells: DataFrame) -> DataFrame:
    """path, tbl, row and fields (name to value) of the rows of document tables, whatever columns each table has.

    The first row has the names; of equal ones the first counts; tables of one row, or without a name, give none.
    """
    rows = cells.where("tbl IS NOT NULL").groupBy("path", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    heads = rows.where("row = 1").select("path", "tbl", F.transform("c", lambda x: F.struct(x["col"].alias("col"), tx.strip(x["value"]).alias("name"))).alias("h"))
    heads = heads.where(F.exists("h", lambda x: x["name"] != ""))
    first = F.filter("h", lambda x: ~F.exists("h", lambda y: (y["name"] == x["name"]) & (y["col"] < x["col"])))
    heads = heads.withColumn("h", first)
    got = rows.where("row > 1").withColumn("own", F.map_from_entries("c")).join(heads, ["path", "tbl"])
    fields = F.map_from_entries(F.transform("h", lambda x: F.struct(x["name"], F.coalesce(F.try_element_at("own", x["col"]), F.lit("")))))
    return got.select("path", "tbl", (F.col("row") - 1).alias("row"), fields.alias("fields"))
