"""Changes as a table: previewed, confirmed, and applied only to values that are still what the preview saw.

A change is (key, field, old, new), values as text, null where there is none. Applying a set twice changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(before: DataFrame, after: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """key, field, old and new of each value that differs, for keys that both have."""
    fields = fields or [c for c in after.columns if c != key and c in before.columns]
    a, b = before.alias("a"), after.alias("b")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.`{f}`").cast("string").alias("old"), F.col(f"b.`{f}`").cast("string").alias("new")) for f in fields])
    rows = a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`")).select(F.col(f"a.`{key}`").alias(key), F.explode(each).alias("x")).select(key, "x.field", "x.old", "x.new")
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def apply(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df after the changes whose old value is still there; others leave their value as it is.

    Several changes of one value are taken as one if they agree, and refused if they don't.
    """
    one = changes.groupBy(key, "field").agg(F.collect_set(F.struct("old", "new")).alias("c")).where(F.size("c") == 1)
    per = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.get("c", F.lit(0))))).alias("__c"))
    met = df.join(per, key, "left")
    out = []
    for f in df.schema.fields:
        c, change = F.col(f"`{f.name}`"), F.try_element_at(F.col("__c"), F.lit(f.name))
        fits = F.col("__c").isNotNull() & change.isNotNull() & c.cast("string").eqNullSafe(change["old"])
        out.append(c if f.name == key else F.when(fits, change["new"].cast(f.dataType)).otherwise(c).alias(f.name))
    return met.select(*out)


def outcome(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """What becomes of each change of a set: applied, done (the new value is there), stale (another one is), missing (no such row or field)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("now")) for c in df.columns if c != key]))
    now = df.select(F.col(f"`{key}`").alias(key), cells.alias("x")).select(key, "x.field", "x.now", F.lit(True).alias("there"))
    many = changes.groupBy(key, "field").agg((F.size(F.collect_set(F.struct("old", "new"))) > 1).alias("many"))
    got = changes.join(many, [key, "field"]).join(now, [key, "field"], "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("many"), "stale").when(F.col("now").eqNullSafe(F.col("old")), "applied").when(F.col("now").eqNullSafe(F.col("new")), "done").otherwise("stale")
    return got.select(key, "field", "old", "new", state.alias("outcome"))
