"""Smaller steps: paragraph choices, previews, page ranges, batches, caches, runs and formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import TASK_ROWS, cut, dealt, discard


def paragraphs_of(c: Column, least: int = 15) -> Column:
    """Lines of least characters at least; if there are none, the sentences."""
    lines = F.filter(F.transform(tx.lines(c), tx.strip), lambda x: F.length(x) >= least)
    sentences = F.filter(F.transform(F.split(c, "(?<=[。！？])"), tx.strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).otherwise(sentences)


def has_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def relevant_paragraphs(df: DataFrame, key: str, order: str, text: str, words: Sequence[str], most: int) -> DataFrame:
    """Paragraphs of each key, those with a keyword first, until the first one that exceeds the budget."""
    w = Window.partitionBy(key).orderBy(F.col("__other"), F.col(order))
    rows = df.withColumn("__other", (~has_any(F.col(text), words)).cast("int")).withColumn("__sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("__sum") <= most).withColumn("rank", F.row_number().over(w).cast("bigint")).drop("__other", "__sum")


def data_sentences(df: DataFrame, text: str, words: Sequence[str], wanted: int) -> DataFrame:
    """Rows with a keyword or a digit; all rows if those are fewer than half of what is wanted."""
    hit = has_any(F.col(text), words) | F.col(text).rlike("[0-9]")
    n = df.agg(F.sum(hit.cast("bigint")).alias("__n"))
    return df.crossJoin(F.broadcast(n)).where(hit | (F.coalesce("__n", F.lit(0)) < wanted // 2)).drop("__n")


def short_summary(c: Column, most: int) -> Column:
    """The start of a text, back to its last full stop if that is past the half."""
    head = F.substring(c, 1, most)
    back = F.length(head) - F.locate("。", F.reverse(head)) + 1
    stop = F.contains(head, F.lit("。")) & (back > most / 2)
    return F.when(F.length(c) <= most, c).when(stop, F.substring(head, F.lit(1), back.cast("int"))).otherwise(head)


def table_descriptions(items: DataFrame, doc: str, order: str, most: int = 5) -> DataFrame:
    """Tables with up to most paragraphs between them and the table before."""
    w = Window.partitionBy(doc).orderBy(order)
    seen = dealt(items, doc, rows=TASK_ROWS).withColumn("__t", F.sum((F.col("kind") == "table").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__t", F.coalesce("__t", F.lit(0)))
    text = F.when((F.col("kind") == "paragraph") & (F.col("text") != ""), F.struct(F.col(order).alias("o"), "text"))
    got = seen.withColumn("x", F.collect_list(text).over(Window.partitionBy(doc, "__t"))).where("kind = 'table'").withColumn("x", F.array_sort("x"))
    last = F.slice("x", F.greatest(F.size("x") - most + 1, F.lit(1)), F.lit(most))
    return got.select(doc, order, F.array_join(F.transform(last, lambda s: s["text"]), "\n").alias("description"))


def head_by_length(df: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Rows of each key whose texts together stay within most characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(F.length(text) + 1).over(w)).where(F.col("__sum") <= most).drop("__sum")


def sheet_preview(cells: DataFrame, most: int = 50) -> DataFrame:
    """The first filled rows of each sheet as text, with the sheet's true size."""
    filled = cells.where(tx.as_text(F.col("value")) != "")
    rows = filled.groupBy("sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]), " | ").alias("line"))
    w = Window.partitionBy("sheet").orderBy("row")
    size = cells.groupBy("sheet").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k").join(size, "sheet")


def page_range(pages: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Pages first to last of each document as one text with a banner for each."""
    rows = pages.where(F.col("page").between(max(1, first), last))
    line = F.concat(F.lit("--- 第 "), F.col("page").cast("string"), F.lit(" 页 ---\n"), F.col("text"))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", line.alias("l")))).alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("text"))


def field_lists(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Values of each field of a key's rows, in order, blanks left out."""
    got = df.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(tx.as_text(F.col(f)) != "", F.struct(F.col(order).alias("o"), tx.as_text(F.col(f)).alias("v"))))).alias(f) for f in fields])
    return got.select(key, *[F.transform(f, lambda s: s["v"]).alias(f) for f in fields])


def extend_new(old: Column, new: Column) -> Column:
    """The old values, then those of the new ones that aren't there yet, each once."""
    return F.concat(old, F.array_distinct(F.filter(new, lambda x: ~F.array_contains(old, x))))


def batches(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def progress(done: Column, total: Column, low: int, high: int) -> Column:
    """Progress of a step that goes from low to high percent."""
    return F.greatest(F.lit(low), F.least(F.lit(high), (low + F.floor(done * (high - low) / F.greatest(total, F.lit(1)))).cast("int")))


def topic(c: Column) -> Column:
    """What a question is about, by its words: the first of these that fits."""
    return F.when(c.rlike("金额|价格|费用|总价"), "amount").when(c.rlike("日期|时间|期限|有效期"), "date").when(c.rlike("甲方|乙方|公司|当事人"), "party").otherwise("other")


def spread_over_runs(runs: DataFrame, keys: list[str], order: str, text: str, values: dict[str, str]) -> DataFrame:
    """Fills placeholders that may lie across the runs of a paragraph; each run keeps its length, the last takes the rest."""
    w = Window.partitionBy(*keys)
    at = w.orderBy(order)
    whole = runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), "").alias("__all"))
    full = reduce(lambda acc, kv: F.replace(acc, F.lit("{{" + kv[0] + "}}"), F.lit(kv[1])), values.items(), F.col("__all"))
    rows = runs.join(whole, keys).withColumn("__new", full).withColumn("__from", F.coalesce(F.sum(F.length(text)).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__last", F.max(order).over(w))
    part = F.when(F.col(order) == F.col("__last"), F.substr("__new", F.col("__from") + 1)).otherwise(F.substr("__new", F.col("__from") + 1, F.length(text)))
    return rows.withColumn(text, F.when(F.col("__new") == F.col("__all"), F.col(text)).otherwise(part)).drop("__all", "__new", "__from", "__last")


def changed_formats(rows: DataFrame, keys: list[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Names of the formats that differ between two columns, over all cells of a row."""
    names = F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(a)) for a, b in pairs])
    got = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(names, lambda x: x.isNotNull()))))).alias("x"))
    return got.select(*keys, F.array_join("x", ",").alias("changed"))


def batch_fill(headers: DataFrame, fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of values below the header that a field's name contains or is contained in; the first field wins.

    Headers and fields are those of one template, or of many, told apart by the columns of ``by``.
    """
    fits = lambda h, f: F.contains(h, f) | F.contains(f, h)
    pairs = headers.join(fields, list(by)) if by else headers.join(F.broadcast(fields))
    pairs = pairs.where(fits(F.lower("header"), F.lower("field")))
    best = pairs.groupBy(*by, "col").agg(F.min_by("values", "ord").alias("values"))
    return best.select(*by, "col", F.posexplode(F.split("values", ",")).alias("k", "value")).select(*by, (F.col("k") + 2).cast("bigint").alias("row"), "col", "value")


def clamp_position(position: Column, count: Column) -> Column:
    """A 1-based place within a document; digits beyond the end mean the last paragraph, anything else stays null."""
    return F.greatest(F.lit(1), F.least(position.try_cast("bigint"), count))


def live_results(cache: DataFrame, now: float, most: int = 1000) -> DataFrame:
    """Cached results that haven't expired, the most recent ones."""
    return cache.where(F.col("expire_at") > now).orderBy(F.col("used_at").desc(), "key").limit(most)


def invalidate(cache: DataFrame, file_id: int) -> DataFrame:
    """A cache without the results that any of its files took part in."""
    return cache.where(~F.array_contains(F.split("file_ids", ","), F.lit(str(file_id))))


def direct_paragraphs(df: DataFrame, key: str, text: str, most: int = 50) -> DataFrame:
    """The first paragraphs of each text between blank lines, as they are read without an index: key, page, content, score 1."""
    rows = df.select(key, F.posexplode(F.split(text, "\n\n")).alias("page", "content")).withColumn("content", tx.strip(F.col("content"))).where("content != ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("page"))
    return rows.withColumn("__k", place).where(F.col("__k") <= most).select(key, F.col("page").cast("bigint").alias("page"), "content", F.lit(1.0).alias("hybrid_score"))


def context_files(chunks: DataFrame, group: str, order: str, path: str, name: str) -> DataFrame:
    """Names of the files of a context in order of their first chunk: group, place, filename.

    A chunk without a name has the last part of its path, or 文档 with its number.
    """
    number = F.row_number().over(Window.partitionBy(group).orderBy(order))
    base = F.element_at(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    own = F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(base, F.lit("")), F.concat(F.lit("文档"), F.col("__n").cast("string")))
    first = chunks.withColumn("__n", number).withColumn("filename", own).groupBy(group, "filename").agg(F.min("__n").alias("__first"))
    return first.select(group, F.row_number().over(Window.partitionBy(group).orderBy("__first")).cast("bigint").alias("place"), "filename")


def named_sources(rows: DataFrame, source: str, files: DataFrame) -> DataFrame:
    """rows with the display name of their source, which is a file's path or the last part of it; files: path, filename."""
    base = F.element_at(F.split("path", "/"), -1)
    names = files.select(F.explode(F.array_distinct(F.array("path", base))).alias("__source"), "filename").groupBy("__source").agg(F.max("filename").alias("display_name"))
    return rows.join(names, F.col(source) == F.col("__source"), "left").drop("__source")


def first_filled_row(cells: DataFrame, key: str, within: int = 10, longest: int = 30) -> DataFrame:
    """Headers of a sheet: the distinct cells of up to longest letters of its first row of within that has any: key, place, header.

    cells: key, row, col, value.
    """
    own = cells.withColumn("header", tx.as_text(F.col("value"))).where((F.col("row") <= within) & (F.col("header") != ""))
    first = own.groupBy(key).agg(F.min("row").alias("__row"))
    rows = own.join(first, key).where((F.col("row") == F.col("__row")) & (F.length("header") <= longest)).groupBy(key, "header").agg(F.min("col").alias("__col"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("__col")).cast("bigint").alias("place"), "header")


def half_width_name(c: Column) -> Column:
    """A field's name without spaces and with plain parentheses."""
    return F.translate(tx.strip(c), "（） ", "()")


def edit_heading(paragraphs: DataFrame, doc: str, at: int, text: str | None) -> DataFrame:
    """Gives the heading number at of each document (counted from 1; level above 0) new text, or deletes it without one."""
    nth = F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy(doc).orderBy("ordinal"))
    rows = paragraphs.withColumn("__hit", (F.col("level") > 0) & (nth == at))
    if text is None:
        return rows.where("NOT __hit").drop("__hit")
    return rows.withColumn("text", F.when(F.col("__hit"), F.lit(text)).otherwise(F.col("text"))).drop("__hit")


def apply_all(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[dict]]:
    """Steps one after another up to the first that fails; the rows so far, and what became of each step.

    The rows of a step are written into the shared folder before the next one begins. So a step that fails when its rows are
    computed is told as that step's failure, and the rows before it are what is returned.
    """
    done: list[dict] = []
    for name, step in steps:
        try:
            made = cut(step(df), "step")
        except Exception as e:  # noqa: BLE001
            return df, [*done, {"step": name, "success": False, "message": str(e), "rows": None}]
        discard(df)
        df = made
        done.append({"step": name, "success": True, "message": "", "rows": df.count()})
    return df, done


# The title of a file's text, what stands for a cut, characters of a workbook's text.
SOURCE_TITLE, SOURCE_CUT, SOURCE_CHARS = ("=== 文件：", " ===\n"), "\n...[内容过长已截断]...", 60_000


def cut_at_line(c: Column, most: int = SOURCE_CHARS) -> Column:
    """A text's beginning of most characters, back to the last line's end in it, with a mark; shorter texts are whole."""
    head = F.substring(c, 1, most)
    back = F.instr(F.reverse(head), "\n")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when((back > 0) & (back < most), F.substring(c, F.lit(1), most - back)).otherwise(head), F.lit(SOURCE_CUT)))


def source_texts(files: DataFrame, group: str, order: str, name: str, text: str, workbook: Column | None = None) -> DataFrame:
    """group and text: what a model reads of the files of each group, below their names; blank files are left out.

    Texts of workbooks are cut to SOURCE_CHARS. A group is what one question is asked about.
    """
    body = F.col(text) if workbook is None else F.when(workbook, cut_at_line(F.col(text))).otherwise(F.col(text))
    rows = files.withColumn("__t", tx.strip(body)).where("__t != ''")
    one = F.concat(F.lit(SOURCE_TITLE[0]), F.col(name), F.lit(SOURCE_TITLE[1]), "__t")
    got = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("l")))).alias("x"))
    return got.select(group, F.array_join(F.transform("x", lambda s: s["l"]), "\n\n").alias("text"))
