"""Queries that write tables as office files and read these back; loaded with the catalogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import extras, metadata, tables, workbooks
from ..session import dealt
from ..sources import office
from .catalog import query, s_strip, table

#: Rows of a workbook: the orders of so many customers together.
TOGETHER = 8
#: Rows of a document's table: a document is made and read in one task, so a larger table is many documents.
TABLE_ROWS = 1_000


def _order_books(spark, sf_dir):
    """Workbooks of orders, several customers each: path and content."""
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / TOGETHER).cast("string").alias("path"), "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return office.as_xlsx(rows, "path", "o_orderkey")


def _order_cells(spark, sf_dir):
    return office.parsed(_order_books(spark, sf_dir), office.CELLS, lambda d: office.parse_xlsx(d)[0])


_BOOKS = f"""o AS (SELECT CAST(o_custkey // {TOGETHER} AS VARCHAR) AS path, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS p, row_number() OVER (PARTITION BY o_custkey // {TOGETHER} ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey // {TOGETHER}) AS n FROM orders)"""


@query(
    f"""WITH {_BOOKS}, l AS (SELECT *, (k - 1) // 20 AS g, 'o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus || CASE WHEN p <> '' THEN ' | o_orderpriority: ' || p ELSE '' END AS line FROM o)
 SELECT path, CAST(g * 20 + 2 AS BIGINT) AS start_row, CAST(max(k) + 1 AS BIGINT) AS end_row, '## 表格区域：Sheet1（第 ' || (g * 20 + 2) || ' 到 ' || (max(k) + 1) || ' 行）' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS content FROM l GROUP BY path, g"""
)
def workbook_line_chunks(spark, sf_dir):
    """Workbooks written from orders come back as chunks of named lines."""
    return workbooks.line_chunks(_order_cells(spark, sf_dir)).drop("sheet")


@query(
    f"""WITH {_BOOKS}, l AS (SELECT *, CASE WHEN n <= 75 THEN 0 ELSE (k - 1) // 50 END AS g, CASE WHEN n <= 75 THEN n ELSE 50 END AS per, '| ' || o_orderkey || '|' || o_orderstatus || '|' || p || ' |' AS line FROM o)
 SELECT path, CAST(g * per AS BIGINT) AS start_row, CAST(least(g * per + per, n) AS BIGINT) AS end_row, '## 表格工作簿：Sheet1（第' || (g * per + 1) || '-' || least(g * per + per, n) || '行，共' || n || '行）' || chr(10) || chr(10) || '| o_orderkey | o_orderstatus | o_orderpriority |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS content
 FROM l GROUP BY path, g, per, n"""
)
def workbook_table_chunks(spark, sf_dir):
    return workbooks.table_chunks(_order_cells(spark, sf_dir)).drop("sheet")


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, '## 空白表格模板（待填充字段）' || chr(10) || '姓名 | 电话 | 地址 | 编号 | 备注' AS content FROM customer WHERE c_custkey % 3 <> 0")
def workbook_blank_templates(spark, sf_dir):
    """Customers' workbooks: a third has a row, a third names alone, a third isn't a workbook."""

    def make(parts):
        for pdf in parts:
            kinds = {0: lambda k: office.xlsx_bytes({"s": [["name"], [f"c{k}"]]}), 1: lambda k: office.xlsx_bytes({"s": [["name"]]}), 2: lambda k: b"not a workbook"}
            yield pd.DataFrame({"path": pdf["c_custkey"].astype(str), "content": [kinds[k % 3](k) for k in pdf["c_custkey"]]})

    keys = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    files = keys.mapInPandas(make, "path string, content binary")
    names = keys.select(F.col("c_custkey").cast("string").alias("path"))  # without making the files once more
    return workbooks.blank_templates(names, office.parsed(files, office.CELLS, lambda d: office.parse_xlsx(d)[0]))


def _part_documents(spark, sf_dir):
    """Documents of parts by size, TABLE_ROWS rows each: a table of brand, type and key, where equal brands span rows, and every third row's type spans two columns.

    A file is named by its size and its number among those of the size.
    """

    def one(pdf):
        rows, last = [[("brand", 1, False), ("type", 1, False), ("key", 1, False), ("key", 1, False)]], None
        for r in pdf.sort_values("p_partkey").itertuples(index=False):
            wide = r.p_partkey % 3 == 0
            rows.append([(r.p_brand, 1, r.p_brand == last), *([(r.p_type, 2, False)] if wide else [(r.p_type, 1, False), (f"k{r.p_partkey}", 1, False)]), ("x & y", 1, False)])
            last = r.p_brand
        return pd.DataFrame({"path": [f"{pdf['p_size'].iloc[0]}/{pdf['part'].iloc[0]}"], "content": [office.docx_bytes([("Parts", 1)], office.table_xml(rows))]})

    rows = tables.split_rows(table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_brand", "p_type"), "p_partkey", TABLE_ROWS, "p_size")
    return rows.groupBy("p_size", "part").applyInPandas(one, "path string, content binary")


@query(
    """SELECT CAST(p_size AS VARCHAR) AS path, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS row, p_brand AS brand, p_type AS type, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'k' || p_partkey END AS key, CAST(3 AS BIGINT) AS n_fields FROM part"""
)
def document_table_frames(spark, sf_dir):
    """Tables with spans come back as rows with names; of two columns of one name the first counts."""
    cells = office.parsed(_part_documents(spark, sf_dir), office.TABLE_CELLS, office.parse_docx_tables)
    f = F.col("fields")
    of, at = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint")
    return workbooks.frames(cells).select(of.alias("path"), (at * TABLE_ROWS + F.col("row")).alias("row"), f["brand"].alias("brand"), f["type"].alias("type"), f["key"].alias("key"), F.size(f).cast("bigint").alias("n_fields"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10)), 1) AS i FROM documents),
 w AS (SELECT doc_id, i, trim(regexp_replace(l, '[\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]+', ' ', 'g')) AS t FROM l)
 SELECT doc_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM w WHERE t <> '' GROUP BY doc_id"""
)
def damaged_documents(spark, sf_dir):
    """Documents as files whose list of members is cut off give all of their paragraphs."""

    def make(parts):
        for pdf in parts:
            out = []
            for text in pdf["text"]:
                data = office.docx_bytes([(line, 0) for line in text.split("\n")])
                out.append(data[: data.rindex(b"PK\x01\x02") - 40])
            yield pd.DataFrame({"path": pdf["doc_id"].astype(str), "content": out})

    clean = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", " ")
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", clean.alias("text")).mapInPandas(make, "path string, content binary")
    rows = office.parsed(files, office.PIECES, office.recover_docx).where("error IS NULL")
    got = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return got.select(F.col("path").cast("bigint").alias("doc_id"), "n", F.md5(F.array_join(F.transform("x", lambda s: s["text"]), "\n")).alias("digest"))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10)), 1) AS i FROM conversations),
 p AS (SELECT conv_id, turn, i, l FROM l WHERE l <> '' UNION ALL SELECT conv_id, turn, 0, turn || '.docx' FROM conversations)
 SELECT conv_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(l, chr(10) ORDER BY turn, i)) AS digest, CAST(count(DISTINCT turn) AS BIGINT) AS headings FROM p GROUP BY conv_id"""
)
def merged_documents(spark, sf_dir):
    """Each turn of a conversation as a document, those of a conversation merged into one and read back."""

    def make(parts):
        for pdf in parts:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "path": "in/" + pdf["turn"].astype(str) + ".docx", "content": [office.docx_bytes([(line, 0) for line in t.split("\n")]) for t in pdf["text"]]})

    clean = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", " ")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), clean.alias("text"))
    merged = office.merged_docx(rows.mapInPandas(make, "conv_id bigint, turn bigint, path string, content binary"), "conv_id", "turn")
    schema = "path string, ordinal bigint, kind string, style string, text string, bold boolean, tbl bigint, error string"
    back = office.parsed(merged.select(F.col("conv_id").cast("string").alias("path"), "content"), schema, office.parse_docx).where("text != ''")
    got = back.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("x"), F.count_if(F.col("style") == "heading 1").alias("headings"))
    return got.select(F.col("path").cast("bigint").alias("conv_id"), "n", F.md5(F.array_join(F.transform("x", lambda s: s["text"]), "\n")).alias("digest"), "headings")


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' AND length(text) > 200 THEN left(text, 200) ELSE text END AS h FROM conversations),
 b AS (SELECT conv_id, turn, role, CASE WHEN h = text THEN text WHEN instr(reverse(h), chr(10)) BETWEEN 1 AND 199 THEN left(h, 200 - instr(reverse(h), chr(10))) || chr(10) || '...[内容过长已截断]...' ELSE h || chr(10) || '...[内容过长已截断]...' END AS t FROM c),
 s AS (SELECT *, {s_strip('t')} AS x FROM b) SELECT conv_id, string_agg('=== 文件：' || role || ' ===' || chr(10) || x, chr(10) || chr(10) ORDER BY turn) AS text FROM s WHERE x <> '' GROUP BY conv_id"""
)
def source_texts(spark, sf_dir):
    """Turns as files of a conversation, users' ones as workbooks that are cut at a line."""
    cut = F.when(F.col("role") == "user", extras.cut_at_line(F.col("text"), 200)).otherwise(F.col("text"))
    return extras.source_texts(table(spark, sf_dir, "conversations").withColumn("text", cut), "conv_id", "turn", "role", "text")


#: Events of the table as steps of work on files.
_KINDS = {"signup": "start", "view": "parse", "click": "index", "purchase": "done", "error": "fail"}
SLICES = 5
#: Events of all slices from which each slice goes into one more file.
EVENTS_OF_FILE = 1_000_000


def _event_files(spark, sf_dir, folder: str, first: int = 0, last: int = SLICES, files: int = 1) -> str:
    """Writes slices of the events by time, one after another, each into so many files at most, and returns their folder."""
    rows = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type"))
    at = F.floor((F.dayofmonth("ts") - 1) * SLICES / 31)
    rows = rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("file_id"), kind.alias("kind"), at.alias("slice"))
    for k in range(first, last):
        rows.where(F.col("slice") == k).drop("slice").repartition(files).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


@query(
    """WITH e AS (SELECT user_id AS f, event_id, epoch_ms(ts) AS ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'parse' WHEN 'click' THEN 'index' WHEN 'purchase' THEN 'done' ELSE 'fail' END AS k FROM events),
 r AS (SELECT *, sum(CASE WHEN k = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY ms, event_id) AS run, row_number() OVER (PARTITION BY f ORDER BY ms, event_id) AS n FROM e),
 z AS (SELECT f, run, min(n) AS stop FROM r WHERE run > 0 AND k IN ('done', 'fail') GROUP BY f, run),
 c AS (SELECT r.*, z.stop FROM r LEFT JOIN z USING (f, run) WHERE run > 0 AND (z.stop IS NULL OR r.n <= z.stop)),
 g AS (SELECT *, row_number() OVER (PARTITION BY f, run, k ORDER BY n) - 1 AS nth, lead(ms) OVER (PARTITION BY f ORDER BY n) AS following FROM c),
 p AS (SELECT f, run, max(CASE k WHEN 'start' THEN 5 WHEN 'parse' THEN least(49, 10 + 13 * nth) WHEN 'index' THEN least(89, 70 + 10 * nth) WHEN 'done' THEN 100 ELSE 0 END) AS progress, arg_max(k, n) AS last_k, max(ms) AS last_ms FROM g GROUP BY f, run),
 w AS (SELECT max(ms) - 3600000 AS mark FROM e),
 s AS (SELECT f, count(*) FILTER (k NOT IN ('done', 'fail') AND ((following IS NOT NULL AND following - ms > 86400000) OR (following IS NULL AND ms + 86400000 < mark))) AS stalls, count(*) FILTER (k = 'fail') AS failures FROM g, w GROUP BY f),
 l AS (SELECT f, max(run) AS run FROM p GROUP BY f)
 SELECT CAST(u.f AS BIGINT) AS file_id, CAST(coalesce(l.run, 0) AS BIGINT) AS run, CASE WHEN l.run IS NULL THEN 'pending' WHEN last_k = 'done' THEN 'done' WHEN last_k = 'fail' THEN 'failed' WHEN last_ms + 86400000 < mark THEN 'stalled' ELSE 'processing' END AS status,
 CAST(coalesce(progress, 0) AS INTEGER) AS progress, CAST(coalesce(failures, 0) AS BIGINT) AS failures, CAST(coalesce(stalls, 0) AS BIGINT) AS stalls FROM (SELECT DISTINCT f FROM e) u LEFT JOIN l USING (f) LEFT JOIN p ON p.f = l.f AND p.run = l.run LEFT JOIN s ON s.f = l.f CROSS JOIN w"""
)
def task_progress(spark, sf_dir):
    """Events as a stream that comes a slice at a time; the states at its end are those of a replay of all events."""
    from ..session import fresh_dir
    from ..streaming.progress import track

    folder, got = fresh_dir(spark, "events"), None
    files = -(-table(spark, sf_dir, "events").count() // EVENTS_OF_FILE) or 1
    for k in range(SLICES):  # a slice is one batch, however many files it has
        stream = spark.readStream.schema("event_id bigint, ts timestamp, file_id bigint, kind string").parquet(_event_files(spark, sf_dir, folder, k, k + 1, files))
        got = track(spark, stream, folder)
    return got


@query("SELECT CAST(o_custkey AS BIGINT) AS file_id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal >= 0 AND c_custkey % 4 <> 0 THEN 'ok' ELSE 'not indexed' END AS outcome FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = o_custkey")
def file_guard(spark, sf_dir):
    """Orders as requests for files, customers as the files."""
    files = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").cast("bigint").alias("file_id"), F.when((F.col("c_acctbal") >= 0) & (F.col("c_custkey") % 4 != 0), "indexed").otherwise("parsed").alias("status"))
    return metadata.guard(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("file_id")), files)


#: How long a result lives, and how many there are; one shard, whose order SQL can follow.
_LIFE, _HELD = 3 * 86_400_000, 60


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, epoch_ms(ts) AS ms, user_id || ':' || event_type AS key FROM events), o AS (SELECT *, row_number() OVER (ORDER BY ms, event_id) AS n, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS nth, lag(ms) OVER (PARTITION BY key ORDER BY ms, event_id) AS before FROM e),
 b AS (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY nth) AS p FROM o),
 d AS (SELECT b.*, CASE WHEN p IS NULL THEN NULL ELSE (SELECT count(DISTINCT x.key) FROM b x WHERE x.n > b.p AND x.n < b.n) END AS others FROM b),
 r AS (SELECT event_id, key, nth, ms AS put, false AS hit FROM d WHERE nth = 1 UNION ALL SELECT d.event_id, d.key, d.nth, CASE WHEN d.others < {_HELD} AND d.ms < r.put + {_LIFE} THEN r.put ELSE d.ms END, d.others < {_HELD} AND d.ms < r.put + {_LIFE} FROM r JOIN d ON d.key = r.key AND d.nth = r.nth + 1)
 SELECT CAST(event_id AS BIGINT) AS event_id, key, hit FROM r"""
)
def cache_replay(spark, sf_dir):
    """Events as requests for results of users and kinds: which of them the cache answers."""
    from ..session import fresh_dir
    from ..streaming import cache

    folder = fresh_dir(spark, "requests")
    rows = spark.readStream.schema("event_id bigint, ts timestamp, file_id bigint, kind string").option("maxFilesPerTrigger", 1).parquet(_event_files(spark, sf_dir, folder))
    kinds = F.element_at(F.create_map(*[F.lit(x) for a, b in _KINDS.items() for x in (b, a)]), F.col("kind"))
    stream = rows.select("event_id", "ts", F.concat(F.col("file_id").cast("string"), F.lit(":"), kinds).alias("key"), F.col("file_id").cast("string").alias("files"), F.lit("request").alias("kind"))
    return cache.replay(spark, stream, folder, ttl=_LIFE, most=_HELD, shards=1)
