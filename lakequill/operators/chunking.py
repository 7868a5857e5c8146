"""Documents to chunks: packed text, table rows in groups, raw slices, image anchors, page routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def chunks(docs: DataFrame, doc: str, pieces: Column, limit: int = tx.CHUNK) -> DataFrame:
    """doc, pos (0-based), chunk_id, content, header and page of each packed chunk; a document never leaves its row."""
    rows = docs.select(F.col(doc), F.posexplode(tx.pack(pieces, limit)).alias("pos", "c"))
    return rows.select(doc, F.col("pos").cast("bigint").alias("pos"), F.concat(F.col(doc).cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("chunk_id"), "c.content", "c.header", F.col("c.page").cast("bigint").alias("page"))


def summaries(chunk_rows: DataFrame, doc: str) -> DataFrame:
    first = chunk_rows.groupBy(doc).agg(F.min_by("content", "pos").alias("content"))
    return first.select(doc, tx.summary(F.col("content")).alias("summary"))


def chunk_stats(chunk_rows: DataFrame, short: int = 50) -> DataFrame:
    n = F.length("content")
    return chunk_rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.avg((n < short).cast("double")), 6).alias("short_share"))


def row_groups(df: DataFrame, key: str, order: str, size: int, rendered: Column, sep: str = "\n") -> DataFrame:
    """Rendered rows of each key in groups of size, in order; blank rows don't count."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("__line", rendered).where("__line != ''").withColumn("__g", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    got = rows.groupBy(key, F.col("__g").alias("grp")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__line").alias("l")))).alias("x"), F.count(F.lit(1)).alias("n_rows"))
    return got.select(key, "grp", "n_rows", F.array_join(F.transform("x", lambda s: s["l"]), sep).alias("content"))


def slices(df: DataFrame, key: str, content: Column, size: int, most: int = 50) -> DataFrame:
    """Pieces of size characters of each row's content, the first ones up to most."""
    count = F.least(F.ceil(F.length("__c") / size), F.lit(most)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("__c"), i * size + 1, F.lit(size)))
    return df.select(key, content.alias("__c")).where("__c != ''").select(key, F.posexplode(parts).alias("pos", "content")).withColumn("pos", F.col("pos").cast("bigint"))


def image_context(items: DataFrame, doc: str, order: str, reach: int = 200) -> DataFrame:
    """Image rows with the end of the text before and the start of the text after them."""
    w = Window.partitionBy(doc).orderBy(order)
    is_text = F.when(F.col("kind") == "text", F.col("content"))
    before = F.last(is_text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(is_text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.concat(F.coalesce(F.right(before, F.lit(reach)), F.lit("")), F.coalesce(F.left(after, F.lit(reach)), F.lit("")))
    return items.withColumn("nearby", near).where("kind = 'image'").select(doc, order, "content", "nearby")


def page_route(pages: DataFrame) -> DataFrame:
    """How a page is read: by its text if it has 50 characters, else by sight if it has a table or a large image."""
    large = (F.col("img_w") > 400) & (F.col("img_h") > 400)
    route = F.when(F.length(tx.strip(F.col("text"))) >= 50, "text").when(F.col("has_table") | large, "vision").otherwise("text")
    return pages.select("page_no", route.alias("route"))


def usable_image(w: Column, h: Column) -> Column:
    """At least 50 pixels each way and not narrower than 1 to 8."""
    return (w >= 50) & (h >= 50) & (w / h >= 1 / 8) & (w / h <= 8)
