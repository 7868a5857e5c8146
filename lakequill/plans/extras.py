"""Queries of the smaller steps; loaded with the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation, extras, retrieval, sheets, tables
from .catalog import _GRAM_SQL, _WORDS_SQL, _jaccard_sql, query, s_strip, s_text, table
from .fixtures import inline, spread, stated, values


@query(f"SELECT page_no, img_w >= 50 AND img_h >= 50 AND img_w / img_h >= 0.125 AND img_w / img_h <= 8 AS usable FROM {values('pdf_pages')} WHERE img_h > 0")
def image_filter(spark, sf_dir):
    return spread(spark, sf_dir, "pdf_pages").where("img_h > 0").select("page_no", chunking.usable_image(F.col("img_w"), F.col("img_h")).alias("usable"))


_LONG_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}), lambda l: length(l) >= 15)"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([。！？])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {s_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(CASE WHEN len({_LONG_LINES}) > 0 THEN len({_LONG_LINES}) ELSE len({_SENTENCES}) END AS BIGINT) AS n FROM documents")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(extras.paragraphs_of(F.col("text"))).cast("bigint").alias("n"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 0 ELSE 1 END AS o, text FROM conversations), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY o, turn ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY o, turn) AS rank FROM r)
 SELECT conv_id, turn, CAST(rank AS BIGINT) AS rank FROM s WHERE c <= 500""")
def relevant_paragraphs(spark, sf_dir):
    return extras.relevant_paragraphs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["the"], 500).select("conv_id", "turn", "rank")


@query(f"SELECT chunk_id FROM {values('chunks')} WHERE contains(content, '合同') OR regexp_matches(content, '[0-9]')")
def data_sentences(spark, sf_dir):
    return extras.data_sentences(spread(spark, sf_dir, "chunks"), "content", ["合同"], 4).select("chunk_id")


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN instr(reverse(left(text, 80)), '。') > 0 AND 81 - instr(reverse(left(text, 80)), '。') > 40 THEN left(text, 81 - instr(reverse(left(text, 80)), '。')) ELSE left(text, 80) END AS head FROM documents""")
def pdf_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extras.short_summary(F.col("text"), 80).alias("head"))


@query(f"""WITH i AS (SELECT *, coalesce(sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM {values('items')}),
 p AS (SELECT doc, t, pos, text, row_number() OVER (PARTITION BY doc, t ORDER BY pos DESC) AS k FROM i WHERE kind = 'paragraph' AND text <> ''), d AS (SELECT doc, t, string_agg(text, chr(10) ORDER BY pos) AS x FROM p WHERE k <= 5 GROUP BY doc, t)
 SELECT i.doc, i.pos, coalesce(d.x, '') AS description FROM i LEFT JOIN d USING (doc, t) WHERE kind = 'table'""")
def table_description(spark, sf_dir):
    return extras.table_descriptions(spread(spark, sf_dir, "items"), "doc", "pos")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS c FROM conversations) WHERE c <= 300")
def template_head(spark, sf_dir):
    return extras.head_by_length(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 300).select("conv_id", "turn")


@query(f"""WITH f AS (SELECT sheet, row, string_agg(value, ' | ' ORDER BY col) AS line FROM {values('sheet')} WHERE {s_text('value')} <> '' GROUP BY sheet, row), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS k FROM f)
 SELECT r.sheet, r.row, r.line, z.n_rows, z.n_cols FROM r JOIN (SELECT sheet, max(row) AS n_rows, max(col) AS n_cols FROM {values('sheet')} GROUP BY sheet) z USING (sheet) WHERE k <= 2""")
def sheet_preview(spark, sf_dir):
    return extras.sheet_preview(spread(spark, sf_dir, "sheet"), 2)


@query(f"SELECT row, col, value FROM {values('sheet')} WHERE sheet = 's1' AND row = 3")
def sheet_row(spark, sf_dir):
    return spread(spark, sf_dir, "sheet").where("sheet = 's1' AND row = 3").select("row", "col", "value")


@query("SELECT conv_id, string_agg('--- 第 ' || turn || ' 页 ---' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn BETWEEN 1 AND 2 GROUP BY conv_id")
def pdf_page_range(spark, sf_dir):
    return extras.page_range(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "page"), "conv_id", 0, 2)


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def field_arrays(spark, sf_dir):
    got = extras.field_lists(table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey")), "n_regionkey", "k", ["n_name", "n_nationkey"])
    return got.select("n_regionkey", F.array_join("n_name", ",").alias("names"), F.array_join("n_nationkey", ",").alias("keys"))


@query("SELECT n_regionkey, 'x,' || coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS merged FROM nation GROUP BY n_regionkey")
def sheet_extend(spark, sf_dir):
    got = extras.field_lists(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_name"])
    return got.select("n_regionkey", F.array_join(extras.extend_new(F.array(F.lit("x")), F.concat("n_name", F.array(F.lit("x")), "n_name")), ",").alias("merged"))


@query("SELECT conv_id, batch, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS batch FROM conversations) GROUP BY ALL")
def batching(spark, sf_dir):
    return extras.batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, CAST(greatest(10, least(49, 10 + floor(done * 39 / greatest(total, 1)))) AS INTEGER) AS pct FROM {values('steps')}")
def progress_map(spark, sf_dir):
    return spread(spark, sf_dir, "steps").select("id", extras.progress(F.col("done"), F.col("total"), 10, 49).alias("pct"))


@query(f"SELECT id, CASE WHEN regexp_matches(q, '金额|价格|费用|总价') THEN 'amount' WHEN regexp_matches(q, '日期|时间|期限|有效期') THEN 'date' WHEN regexp_matches(q, '甲方|乙方|公司|当事人') THEN 'party' ELSE 'other' END AS topic FROM {values('questions')}")
def topic_guard(spark, sf_dir):
    return spread(spark, sf_dir, "questions").select("id", extras.topic(F.col("q")).alias("topic"))


@query(f"SELECT h.name, f.field, CAST(len(list_filter(string_split(f.field, ''), lambda c: contains(h.name, c))) AS DOUBLE) / length(f.field) AS share FROM {values('headers')} h, {values('fields')} f")
def overlap_match(spark, sf_dir):
    return tables.overlap_pairs(spread(spark, sf_dir, "headers").select("name"), spread(spark, sf_dir, "fields"))  # names of one template


@query("SELECT doc_id, 'filled_' || doc_id || '.xlsx' AS name FROM documents")
def output_names(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".xlsx"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("filled_"), tx.safe_name(name)).alias("name"))


@query(f"""WITH m AS (SELECT h.g, h.col, arg_min(f.values, f.ord) AS v FROM {values('grid_headers', True)} h JOIN {values('grid_fields', True)} f ON h.g = f.g AND (contains(lower(h.header), lower(f.field)) OR contains(lower(f.field), lower(h.header))) GROUP BY h.g, h.col)
 SELECT g, CAST(i + 1 AS BIGINT) AS row, col, string_split(v, ',')[i] AS value FROM (SELECT g, col, v, unnest(range(1, len(string_split(v, ',')) + 1)) AS i FROM m)""")
def batch_fill(spark, sf_dir):
    return extras.batch_fill(spread(spark, sf_dir, "grid_headers", True), spread(spark, sf_dir, "grid_fields", True), ["g"])


@query(f"""WITH r AS (SELECT *, sum(length(t)) OVER (PARTITION BY para ORDER BY run) - length(t) AS before, max(run) OVER (PARTITION BY para) AS last FROM {values('runs')}), w AS (SELECT para, string_agg(t, '' ORDER BY run) AS old FROM r GROUP BY para),
 n AS (SELECT para, old, replace(replace(old, chr(123) || chr(123) || '编号' || chr(125) || chr(125), 'A-7'), chr(123) || chr(123) || '甲方' || chr(125) || chr(125), '星海') AS new FROM w)
 SELECT r.para, r.run, CASE WHEN old = new THEN t WHEN run = last THEN substring(new, CAST(before AS BIGINT) + 1) ELSE substring(new, CAST(before AS BIGINT) + 1, length(t)) END AS t FROM r JOIN n USING (para)""")
def run_redistribute(spark, sf_dir):
    return extras.spread_over_runs(spread(spark, sf_dir, "runs"), ["para"], "run", "t", {"编号": "A-7", "甲方": "星海"})


@query(f"""SELECT row, concat_ws(',', CASE WHEN bool_or(bold IS DISTINCT FROM bold_new) THEN 'bold' END, CASE WHEN bool_or(color IS DISTINCT FROM color_new) THEN 'color' END) AS changed FROM {values('formats')} GROUP BY row""")
def changed_formats(spark, sf_dir):
    return extras.changed_formats(spread(spark, sf_dir, "formats"), ["row"], [("bold", "bold_new"), ("color", "color_new")])


@query(f"SELECT sheet, row, col, CASE WHEN sheet = 's1' AND row = 2 THEN 'bold=true;fill=FFFF00' END AS style FROM {values('sheet')}")
def format_row(spark, sf_dir):
    return sheets.style_row(spread(spark, sf_dir, "sheet"), "s1", 2, {"fill": "FFFF00", "bold": "true"}).select("sheet", "row", "col", "style")


@query("SELECT 's1' AS sheet, CAST(6 AS BIGINT) AS row, CAST(2 AS BIGINT) AS col, '=SUM(B3:B5)' AS value")
def formula_text(spark, sf_dir):
    edit = spark.createDataFrame([("s1", 6, 2, "=SUM(B3:B5)")], "sheet string, row bigint, col bigint, value string")
    return sheets.edit_cells(spread(spark, sf_dir, "sheet"), edit).where("row = 6")


@query(f"SELECT p, greatest(1, least(TRY_CAST(p AS BIGINT), n)) AS place FROM {values('positions')} WHERE TRY_CAST(p AS BIGINT) IS NOT NULL")
def position_clamp(spark, sf_dir):
    return spread(spark, sf_dir, "positions").where(F.col("p").try_cast("bigint").isNotNull()).select("p", extras.clamp_position(F.col("p"), F.col("n")).alias("place"))


@query(f"SELECT key FROM {values('cache')} WHERE expire_at > 60 ORDER BY used_at DESC, key LIMIT 2")
def cache_live(spark, sf_dir):
    return extras.live_results(spread(spark, sf_dir, "cache"), 60.0, 2).select("key")


@query(f"SELECT key FROM {values('cache')} WHERE NOT list_contains(string_split(file_ids, ','), '2')")
def cache_invalidate(spark, sf_dir):
    return extras.invalidate(spread(spark, sf_dir, "cache"), 2).select("key")


@query(f"""WITH c AS (SELECT id, answer, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {values('cases')}), s AS (SELECT id, CASE WHEN len(t) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct(t), ['the', 'date'])) AS DOUBLE) / len(list_distinct(list_concat(t, ['the', 'date']))) END AS s FROM c)
 SELECT id, round(s, 6) AS rerank_score FROM s ORDER BY s DESC LIMIT 1""")
def rerank_top(spark, sf_dir):
    return retrieval.rerank(spread(spark, sf_dir, "cases"), "answer", ["the", "date"], 1, order="id").select("id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"SELECT id, answer, CAST(NULL AS DOUBLE) AS rerank_score FROM {values('cases')}")
def rerank_few(spark, sf_dir):
    return retrieval.rerank(spread(spark, sf_dir, "cases"), "answer", ["the", "date"], 2_000_000_000, order="id").select("id", "answer", "rerank_score")


@query(f"SELECT id, round({_jaccard_sql(_WORDS_SQL)}, 6) AS words, round({_jaccard_sql(_GRAM_SQL)}, 6) AS pairs FROM {values('cases')}")
def overlap_scores(spark, sf_dir):
    a, b = F.col("query"), F.col("answer")
    return spread(spark, sf_dir, "cases").select("id", F.round(tx.jaccard(evaluation.keywords(a), evaluation.keywords(b)), 6).alias("words"), F.round(tx.jaccard(evaluation.bigrams(a), evaluation.bigrams(b)), 6).alias("pairs"))


@query(f"SELECT id, l AS line, CASE WHEN starts_with(l, '# ') THEN 1 WHEN starts_with(l, '## ') THEN 2 WHEN starts_with(l, '### ') THEN 3 WHEN starts_with(l, '|') THEN -1 ELSE 0 END AS level FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM {values('texts')})")
def markdown_lines(spark, sf_dir):
    rows = spread(spark, sf_dir, "texts").select("id", F.explode(tx.lines(F.col("t"))).alias("line"))
    return rows.select("id", "line", sheets.heading_levels(F.col("line")).alias("level"))


@query("SELECT c_custkey, c_custkey || ',\"' || c_name || '\",' || c_mktsegment AS line FROM customer")
def csv_lines(spark, sf_dir):
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit('"')), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS longest, CAST(count(DISTINCT n_name) AS BIGINT) AS distinct_names FROM nation GROUP BY n_regionkey")
def fill_lengths(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("longest"), F.count_distinct("n_name").alias("distinct_names"))


@query("SELECT source, arg_min(doc_id, doc_id) AS doc_id FROM documents GROUP BY source")
def source_dedup(spark, sf_dir):
    from ..operators.predicates import first_of

    return first_of(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")])


@query(f"SELECT id, array_to_string(list_filter(f, lambda v, i: list_position(f, v) = i), ',') AS fields FROM (SELECT id, list_transform(regexp_extract_all(t, '\\{{\\{{([^{{}}]+)\\}}\\}}', 1), lambda x: {s_strip('x')}) AS f FROM {values('templates')})")
def template_fields(spark, sf_dir):
    return spread(spark, sf_dir, "templates").select("id", F.array_join(tables.placeholders(F.col("t")), ",").alias("fields"))


@query(f"WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents), r AS (SELECT doc_id, unnest(range(len(ps))) AS page, unnest(ps) AS content FROM p), s AS (SELECT doc_id, page, {s_strip('content')} AS content FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM s WHERE content <> '') SELECT doc_id, page, content, CAST(1.0 AS DOUBLE) AS hybrid_score FROM k WHERE k <= 50")
def direct_text(spark, sf_dir):
    return extras.direct_paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH n AS (SELECT conv_id, role AS filename, min(turn) AS t FROM conversations GROUP BY conv_id, role) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS place, filename FROM n")
def context_filenames(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("path", F.concat(F.lit("a\\b/"), F.col("role"))).withColumn("name", F.lit(""))
    return extras.context_files(rows, "conv_id", "turn", "path", "name")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE upper(source) END AS display_name FROM documents")
def filename_map(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/"), F.col("source"))).otherwise("nowhere").alias("path"))
    files = table(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("/data/"), F.col("source")).alias("path"), F.upper("source").alias("filename"))
    return extras.named_sources(rows, "path", files).select("doc_id", "display_name")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY c) AS place, h AS header FROM (SELECT o_custkey, h, min(c) AS c FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority, o_orderstatus]) AS h, unnest([1, 2, 3]) AS c FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) WHERE h <> '' GROUP BY o_custkey, h)")
def first_filled_row(spark, sf_dir):
    """Orders of a customer as rows of a sheet, after an empty one."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1)
    cells = rows.select("o_custkey", "row", F.posexplode(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")).alias("col", "value"))
    empty = rows.select("o_custkey").distinct().select("o_custkey", F.lit(1).alias("row"), F.lit(0).alias("col"), F.lit("  ").alias("value"))
    return extras.first_filled_row(cells.unionByName(empty), "o_custkey")


@query("SELECT c_custkey, replace(c_name, ' ', '') || '(' || c_mktsegment || ')' AS name FROM customer")
def half_width_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", extras.half_width_name(F.concat(F.lit(" "), "c_name", F.lit(" （"), "c_mktsegment", F.lit("） "))).alias("name"))


_TURNS = "(SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)"


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' AND nth = 2 THEN 'new' ELSE role END AS text FROM {_TURNS}")
def heading_edit(spark, sf_dir):
    return _headed(spark, sf_dir, "new")


@query(f"SELECT conv_id, turn, role AS text FROM {_TURNS} WHERE NOT (role = 'user' AND nth = 2)")
def heading_delete(spark, sf_dir):
    return _headed(spark, sf_dir, None)


def _headed(spark, sf_dir, text):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("role").alias("text"), F.when(F.col("role") == "user", 1).otherwise(0).alias("level"))
    return extras.edit_heading(rows, "conv_id", 2, text).select("conv_id", F.col("ordinal").alias("turn"), "text")
