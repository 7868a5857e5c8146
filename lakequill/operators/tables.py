"""Reshaping, merging, splitting, matching and filling of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import TASK_ROWS, cut, dealt

#: Pairs that a task makes about, members of a class that go to one row, and fields that are sent to all tasks at most.
PAIRS_OF_TASK, CLASS_ROWS, BROADCAST_ROWS = 10_000_000, 100_000, 1_000_000


def merge_vertical(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All rows by column name, missing ones null, with the name of their source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_file", F.lit(name)) for name, df in parts])


def with_ordinal(df: DataFrame, order: str, partition: str | None = None, name: str = "ordinal") -> DataFrame:
    """1-based place in the given order; within a partition if there is one.

    Without a partition the table is one sheet, whose rows are numbered over range partitions, not in a single task.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(order)).cast("bigint"))
    placed = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ordinals")  # partitions stay as they are now
    rows, before = [], 0
    for r in sorted(placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda x: x["__p"]):  # a row for each partition
        rows.append((r["__p"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "__p int, __before bigint")
    w = Window.partitionBy("__p").orderBy(order)
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__before") + F.row_number().over(w)).cast("bigint")).drop("__p", "__before")


def merge_horizontal(a: DataFrame, a_order: str, b: DataFrame, b_order: str) -> DataFrame:
    """Rows side by side by place; the shorter table is filled with nulls."""
    return with_ordinal(a, a_order).join(with_ordinal(b, b_order), "ordinal", "full")


def split_rows(df: DataFrame, order: str, size: int, partition: str | None = None) -> DataFrame:
    """Adds the 0-based number of the part of size rows that each row belongs to."""
    return with_ordinal(df, order, partition).withColumn("part", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))


def merge_markdown(df: DataFrame, group: str, order: str, title: str, body: str) -> DataFrame:
    """One text of each group: a title and body of each row, rules between them."""
    one = F.concat(F.lit("# "), F.col(title).cast("string"), F.lit("\n\n"), F.col(body))
    got = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))).alias("x"))
    return got.select(group, F.array_join(F.transform("x", lambda s: s["t"]), "\n\n---\n\n").alias("merged"))


def stack_matching(tables: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """All tables that share a column with the template, stacked; else the one with the most columns."""
    norm = lambda s: re.sub(r"[ _/\\]", "", s.lower())
    wanted = {norm(f) for f in fields}
    found = [t for t in tables if wanted & {norm(c) for c in t.columns}] or [max(tables, key=lambda t: len(t.columns))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def match_fields(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """field and the first column (by ord) of the same normal name."""
    f, c = fields.withColumn("k", tx.normal_name(F.col("field"))), columns.withColumn("k", tx.normal_name(F.col("name")))
    best = dealt(c, "k", rows=TASK_ROWS).groupBy("k").agg(F.min_by("name", "ord").alias("name"))
    return dealt(f, "k", rows=TASK_ROWS).join(best, "k", "left").select("field", "name")


def fuzzy_match(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """header and its best field: 3 if equal, 2 if the field contains it, 1 if it contains the field; shorter fields first.

    Names meet by an equal part, as long as a name of the other side is, and the best field of each part is kept, so there is
    work for each part of a name and none for each pair of names. Parts begin as a name of the other side does. Both sides
    grow with the tables whatever Spark guesses of their size, so they are joined by sorting, and none is sent to all tasks.
    """
    h = cut(headers.select("header").distinct().withColumn("k", tx.normal_name(F.col("header"))), "headers")
    f = fields.select(tx.normal_name(F.col("field")).alias("k"), F.struct(F.length("field").alias("n"), F.col("field").alias("field")).alias("own")).where("k IS NOT NULL")
    f = cut(f.groupBy("k").agg(F.min("own").alias("own")), "fields")

    def parts(of: DataFrame) -> Column:
        # lengths of the other side's names, and the characters that they begin with
        n, first = of.where("k IS NOT NULL").agg(F.sort_array(F.collect_set(F.length("k"))), F.array_join(F.sort_array(F.collect_set(F.left("k", F.lit(1)))), "")).first()
        if not n:
            return F.explode(F.array().cast("array<string>"))
        k, size = F.col("k"), F.length("k")
        at = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i <= size) & F.contains(F.lit(first), F.substring(k, i, F.lit(1))))
        fit = F.array(*[F.lit(x) for x in n if x])
        got = F.flatten(F.transform(at, lambda i: F.transform(F.filter(fit.cast("array<int>"), lambda x: x <= size - i + 1), lambda x: F.substring(k, i, x))))
        return F.explode(F.concat(F.array(F.lit("")), got) if 0 in n else got)

    score = lambda n: F.lit(-n).alias("s")
    whole = f.select("k", score(3), "own").unionByName(f.select(parts(h).alias("k"), score(2), "own"))
    whole = whole.groupBy("k").agg(F.min(F.struct("s", "own")).alias("b"))
    held = h.where("k IS NOT NULL").select("header", parts(f).alias("k")).join(f.hint("merge"), "k").select("header", F.struct(score(1), "own").alias("b"))
    none = h.select("header", F.struct(score(0), F.lit(None).cast(f.schema["own"].dataType).alias("own")).alias("b"))
    met = h.join(whole.hint("merge"), "k").select("header", "b").unionByName(held).unionByName(none)
    best = met.groupBy("header").agg(F.min("b").alias("b"))
    return best.select("header", F.col("b.own.field").alias("field"), (-F.col("b.s")).cast("bigint").alias("score"))


def overlap_match(column: Column, field: Column) -> Column:
    """Share of a field's characters that the column's name has."""
    chars = F.filter(F.split(field, ""), lambda x: x != "")
    return F.size(F.filter(chars, lambda x: F.contains(column, x))) / F.size(chars)


def overlap_pairs(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """name, field, share for each pair of a name (name) and a field (field), as ``overlap_match`` has it.

    A share depends on the set of the name's characters and on the field's characters in any order, so it is computed once
    for each pair of such classes, and then told to their members. Classes of many members are dealt in parts.
    """
    n, m = columns.count(), fields.count()
    tasks = max(1, min(4096, n * m // PAIRS_OF_TASK))

    def classes(rows: DataFrame, c: str, key: Column, count: int) -> DataFrame:
        part = F.pmod(F.xxhash64(c), F.lit(-(-count // CLASS_ROWS) or 1)).alias("part")
        got = rows.select(c, F.array_join(key, "").alias(f"{c}_chars"), part).groupBy(f"{c}_chars", "part")
        return got.agg(F.count(F.when(F.col(c).isNull(), 1)).alias("none"), F.collect_list(c).alias("own")).select(f"{c}_chars", F.concat("own", F.array_repeat(F.lit(None).cast("string"), F.col("none").cast("int"))).alias(f"{c}s"))

    left = classes(columns, "name", F.array_sort(F.array_distinct(F.split("name", ""))), n).repartition(tasks, "name_chars", F.hash("names"))
    right = classes(fields, "field", F.array_sort(F.split("field", "")), m)
    # without a hint, one task may take all names
    right = F.broadcast(right) if m <= BROADCAST_ROWS else right.repartition(-(-m // BROADCAST_ROWS), "field_chars", F.hash("fields"))
    met = left.crossJoin(right).select("names", "fields", overlap_match(F.col("name_chars"), F.col("field_chars")).alias("share"))
    return met.select(F.explode("names").alias("name"), "fields", "share").select("name", F.explode("fields").alias("field"), "share")


def fill_rows(df: DataFrame, order: str, mapping: dict[str, str], most: int | None = None, compact: bool = False, partition: str | None = None) -> DataFrame:
    """Long cells (place, field, value) of the mapped columns, rows aligned; compact drops blanks of each field first."""
    rows = with_ordinal(df, order, partition)
    if most is not None:
        rows = rows.where(F.col("ordinal") <= most)
    cells = F.explode(F.array(*[F.struct(F.lit(field).alias("field"), tx.as_text(F.col(f"`{c}`")).alias("value")) for field, c in mapping.items()]))
    keys = [partition] if partition else []
    long = rows.select(*keys, F.col("ordinal").alias("place"), cells.alias("c")).select(*keys, "place", "c.field", "c.value")
    if not compact:
        return long
    w = Window.partitionBy(*keys, "field").orderBy("place")
    return long.where("value != ''").withColumn("place", F.row_number().over(w).cast("bigint"))


def fill_grid(cells: DataFrame, headers: DataFrame, first_row: int) -> DataFrame:
    """Sheet cells (row, col, value) of long fill cells below a header row; single values repeat in each row."""
    per = cells.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("only"))
    height = cells.agg(F.max("place").alias("h"))
    single = per.where("n = 1").crossJoin(F.broadcast(height)).select("field", F.explode(F.sequence(F.lit(1), F.col("h").cast("int"))).alias("place"), F.col("only").alias("value"))
    many = cells.join(per.where("n > 1").select("field"), "field", "left_semi").select("field", "place", "value")
    got = many.unionByName(single.withColumn("place", F.col("place").cast("bigint")))
    return got.join(headers, "field").select((F.col("place") + first_row).cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")


def docx_rows(empties: DataFrame, values: DataFrame) -> DataFrame:
    """Value rows (place) with the table row they go to: empty rows first, then new ones below the last."""
    n = Window.partitionBy("tbl").orderBy("row")
    free = empties.where("is_empty").withColumn("place", F.row_number().over(n).cast("bigint")).select("tbl", "place", F.col("row").alias("own"))
    last = empties.groupBy("tbl").agg(F.max("row").alias("last"), F.sum(F.col("is_empty").cast("bigint")).alias("free"))
    return values.join(last, "tbl").join(free, ["tbl", "place"], "left").select("tbl", "place", "value", F.coalesce("own", F.col("last") + F.col("place") - F.col("free")).cast("bigint").alias("row"))


def fill_labels(paragraphs: DataFrame, answers: DataFrame) -> DataFrame:
    """Paragraphs that end in a field, with or without a colon, get its value; answers are few and sent to all."""
    bare = F.regexp_replace(tx.strip(F.col("text")), "[：:]\\z", "")
    hit = paragraphs.join(F.broadcast(answers), F.endswith(bare, F.col("field")), "left")
    w = Window.partitionBy("ordinal").orderBy(F.length("field").desc(), "field")
    got = hit.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return got.select("ordinal", F.when(F.col("value").isNull(), F.col("text")).otherwise(F.concat("text", "value")).alias("text"))


def placeholders(c: Column) -> Column:
    """Trimmed names in double braces, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)), tx.strip))


def replace_placeholders(c: Column, values: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit("{{" + kv[0] + "}}"), F.lit(kv[1])), values.items(), c)


def header_row(cells: DataFrame, least: int = 3) -> DataFrame:
    """The row with the most filled cells, least of them at least; the first of equals."""
    n = dealt(cells, "sheet", "row", rows=TASK_ROWS).where(tx.as_text(F.col("value")) != "").groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("filled"))
    return n.where(F.col("filled") >= least).orderBy(F.col("filled").desc(), "sheet", "row").limit(1)


def key_value_lines(df: DataFrame, key: str, text: str, fields: Sequence[str]) -> DataFrame:
    """Values of ``name: value`` lines whose name contains a field or is contained in one."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "l"))
    pattern = r"^\s*([^：:]{1,15})[：:]\s*(.+)$"
    rows = rows.withColumn("k", tx.strip(F.regexp_extract("l", pattern, 1))).where("k != ''")
    name = F.coalesce(*[F.when(F.contains(F.col("k"), F.lit(f)) | F.contains(F.lit(f), F.col("k")), F.lit(f)) for f in fields])
    return rows.withColumn("field", name).where("field IS NOT NULL").select(key, F.col("line").cast("bigint").alias("line"), "field", tx.strip_unit(tx.strip(F.regexp_extract("l", pattern, 2))).alias("value"))


def keep_fullest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key, that with the most filled cells, the first of equals; rows without a key all stay."""
    filled = reduce(lambda a, b: a + b, [(tx.as_text(F.col(f"`{c}`")) != "").cast("int") for c in df.columns])
    blank = tx.as_text(F.col(key)) == ""
    own = F.when(blank, F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col(key).cast("string"))
    w = Window.partitionBy("__key").orderBy(F.col("__n").desc(), order)
    return dealt(df.withColumn("__n", filled).withColumn("__key", own), "__key", rows=TASK_ROWS).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__n", "__key", "__rn")
