"""Conditions as rows: each of many tables has its own, and all are matched and filled in one plan.

A rule is (tbl, grp, col, op, v1, v2). Rules of a group are ANDed, groups of a table ORed; operators and comparisons are
those of ``predicates``. A rule's column is the one of that name, or the first that contains it or is contained in it; a
rule whose column or number can't be found holds for all rows.

Groups with an equality or a range of numbers meet their rows by a join: on column and value, or on column and the one or
two steps of a scale that hold the range. Of several such rules, the one with the fewest rows leads. The other groups are
compared with each row, which is what such conditions cost; they are sent to the rows if they are few, and both sides are dealt
out if not. What else a group asks is checked on the pairs that meet, as expressions over the row's cells.

Tables of rules grow with the number of tables, whatever Spark guesses of their size, so joins sort both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_text, normal_name
from ..session import cut, dealt
from .predicates import moment, number

_NUMBER, _DATE = r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$", r"^\d{4}[-/]\d{1,2}([-/]\d{1,2})?( \d{1,2}:\d{2}(:\d{2})?)?$"


def resolved(rules: DataFrame, columns: list[str]) -> DataFrame:
    """Rules with the column they mean, null if there is none."""
    known = F.array(*[F.lit(c) for c in columns])
    near = F.filter(known, lambda c: F.contains(c, F.col("col")) | F.contains(F.col("col"), c))
    return rules.where("col IS NOT NULL").withColumn("own", F.when(F.array_contains(known, F.col("col")), F.col("col")).otherwise(F.get(near, F.lit(0))))


def holds(cell: Column, op: Column, v1: Column, v2: Column) -> Column:
    """Whether a rule holds for a cell (text, null if the row has none); never null."""
    text, c = as_text(cell), F.coalesce(cell, F.lit(""))
    bare1, bare2 = F.replace(v1, F.lit(","), F.lit("")), F.replace(v2, F.lit(","), F.lit(""))
    low, high, x = number(bare1), number(bare2), number(cell)
    known = bare1.rlike(_NUMBER) & low.isNotNull() & ((op != "between") | (bare2.rlike(_NUMBER) & high.isNotNull()))
    dated = (op == "between") & v1.rlike(_DATE) & v2.rlike(_DATE)
    ranged = F.when(op == "gt", x > low).when(op == "lt", x < low).when(op == "gte", x >= low).when(op == "lte", x <= low).otherwise(x.between(low, high))
    return (
        F.when(op == "eq", text == v1).when(op == "neq", text != v1).when(op == "contains", F.contains(c, v1)).when(op == "not_contains", ~F.contains(c, v1))
        .when(op == "empty", text == "").when(op == "not_empty", text != "").when(dated, F.coalesce(moment(cell).between(moment(v1), moment(v2)), F.lit(False)))
        .when(op.isin("gt", "lt", "gte", "lte", "between") & known, F.coalesce(ranged, F.lit(False))).otherwise(F.lit(True))
    )


#: Numbers up to this size have places on scales; a rule with a larger bound leads no join.
FAR = 1e15
#: Groups of rules that are sent to all tasks at most.
SENT = 10_000


def _bounds(v1: Column, v2: Column) -> tuple[Column, Column]:
    return tuple(F.when(F.replace(v, F.lit(","), F.lit("")).rlike(_NUMBER), number(F.replace(v, F.lit(","), F.lit("")))) for v in (v1, v2))


def _step(own: Column, op: Column, v1: Column, v2: Column) -> Column:
    """How a rule finds its rows: -1 by value; for a range, the power of two that is at least its width; null if it can't."""
    low, high = _bounds(v1, v2)
    ranged = (op == "between") & ~(v1.rlike(_DATE) & v2.rlike(_DATE)) & (F.abs(low) < FAR) & (F.abs(high) < FAR)
    width = F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(1.0)))), F.lit(0)).cast("int")
    return F.when(own.isNotNull() & (op == "eq"), F.lit(-1)).when(own.isNotNull() & ranged, width)


def _at(own: Column, step: Column, v: Column) -> Column:
    return F.struct(own.alias("own"), step.cast("int").alias("step"), v.cast("string").alias("v"))


def _place(column: str, step: int) -> Column:
    """A row's place by value, or on a scale of a step; null if its cell is no number there."""
    cell = F.col("cells")[column]
    x = number(cell)
    return _at(F.lit(column), F.lit(step), as_text(cell) if step < 0 else F.when(F.abs(x) < FAR, F.floor(x / float(2**step))))


def _met(lead: Column) -> Column:
    """The places that the rows of a rule have: its value, or the steps from its lower to its upper bound."""
    low, high = _bounds(lead["v1"], lead["v2"])
    size = F.pow(F.lit(2.0), lead["step"])
    first, last = F.floor(low / size), F.floor(high / size)
    steps = F.transform(F.sequence(first, F.greatest(first, F.least(last, first + 2))), lambda v: _at(lead["own"], lead["step"], v))
    return F.when(lead["step"] < 0, F.array(_at(lead["own"], lead["step"], lead["v1"]))).otherwise(steps)


def matches(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """tbl and key of the rows that a table's rules keep, each pair once."""
    names = [c for c in df.columns]
    own = resolved(rules, names).withColumn("v1", F.coalesce("v1", F.lit(""))).withColumn("v2", F.coalesce("v2", F.lit("")))
    own = own.withColumn("step", _step(F.col("own"), F.col("op"), F.col("v1"), F.col("v2")))
    groups = own.groupBy("tbl", "grp").agg(F.collect_list(F.struct("own", "op", "v1", "v2")).alias("asked"), F.collect_list(F.when(F.col("step").isNotNull(), F.struct("own", "v1", "v2", "step"))).alias("leads"))
    groups = cut(groups, "rule-groups")
    kinds = own.select("own", "step").distinct().collect()  # columns of df at most, with some tens of steps each
    used = sorted({r["own"] for r in kinds if r["own"] is not None})
    scales = sorted((r["own"], r["step"]) for r in kinds if r["step"] is not None)
    cells = F.create_map(*[x for c in used for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if used else F.create_map().cast("map<string,string>")
    rows = dealt(df, key, rows=50_000).select(F.col(f"`{key}`").alias(key), cells.alias("cells"))
    kept = F.forall("asked", lambda r: F.when(r["own"].isNull(), F.lit(True)).otherwise(holds(F.col("cells")[r["own"]], r["op"], r["v1"], r["v2"])))
    free = groups.where(F.size("leads") == 0).select("tbl", "asked")
    free = F.broadcast(free) if free.count() <= SENT else free.hint("shuffle_replicate_nl")
    met = rows.join(free, F.lit(True)).where(kept).select("tbl", key)
    if scales:
        each = rows.select(key, "cells", F.explode(F.array(*[_place(c, step) for c, step in scales])).alias("__at")).where("__at.v IS NOT NULL")
        many = each.groupBy("__at").agg(F.count(F.lit(1)).alias("n"))
        led = groups.where(F.size("leads") > 0).select("tbl", "grp", "asked", F.posexplode("leads").alias("k", "lead"))
        led = led.select("tbl", "grp", "asked", "k", F.explode(_met(F.col("lead"))).alias("__at")).join(many.hint("merge"), "__at", "left")
        best = led.groupBy("tbl", "grp", "k").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.first("asked").alias("asked"), F.collect_list("__at").alias("ats"))
        best = best.groupBy("tbl", "grp").agg(F.min_by(F.struct("asked", "ats"), F.struct("n", "k")).alias("b"))
        keyed = best.select("tbl", F.col("b.asked").alias("asked"), F.explode("b.ats").alias("__at"))
        met = met.unionByName(each.join(keyed.hint("merge"), "__at").where(kept).select("tbl", key))
    return met.distinct()


def fill_tables(df: DataFrame, key: str, rules: DataFrame, headers: DataFrame, most: int = 50) -> DataFrame:
    """Cells (tbl, col, place, value) of many templates (headers: tbl, col, header), each from the rows that its rules keep.

    A header takes the column of the same normal name, blanks left out, in the order of ``key``, ``most`` cells at most. A
    table without rules, or whose rules keep no row, is filled from all rows.
    """
    found = cut(matches(df, key, rules), "matches")  # keys, used twice
    tables = headers.select("tbl").distinct()
    none = tables.join(found.select("tbl").distinct().hint("merge"), "tbl", "left_anti")
    known = reduce(lambda a, b: a.unionByName(b), [headers.sparkSession.range(1).select(F.lit(c).alias("name"), F.lit(k).alias("at")) for k, c in enumerate(df.columns)])
    first = known.withColumn("n", normal_name(F.col("name"))).groupBy("n").agg(F.min_by("name", "at").alias("name"))
    wanted = headers.withColumn("n", normal_name(F.col("header"))).join(F.broadcast(first), "n").select("tbl", "col", "name")
    names = [r["name"] for r in wanted.select("name").distinct().collect()] or df.columns[:1]  # columns of df at most
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), as_text(F.col(f"`{c}`")).alias("value")) for c in names]))
    long = dealt(df, key, rows=50_000).select(F.col(f"`{key}`").alias(key), cells.alias("x")).select(key, "x.name", "x.value").where(~F.lower("value").isin("", "nan", "none"))
    place = F.row_number().over(Window.partitionBy("tbl", "col").orderBy(key)).cast("bigint")
    own = found.join(wanted.hint("merge"), "tbl").join(long.hint("merge"), [key, "name"])
    # rows of no table of their own are ranked once, for all tables that take them
    w = Window.partitionBy("name").orderBy(key)
    head = long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("place", F.col("place").cast("bigint"))
    rest = wanted.join(none.hint("merge"), "tbl").join(F.broadcast(head), "name").select("tbl", "col", "place", "value")
    return own.withColumn("place", place).where(F.col("place") <= most).select("tbl", "col", "place", "value").unionByName(rest)
