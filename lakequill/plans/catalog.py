"""Queries that apply the operators to the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, conflicts, evaluation, metadata, predicates, retrieval, sheets, tables
from .fixtures import inline, spread, stated, values

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: White space at the ends of a text, for the SQL dialect's expressions.
B = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
TERMS = ("the", "thst", "ention", "ined")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def s_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+$', '')"


def s_text(x: str) -> str:
    return s_strip(f"coalesce(CAST({x} AS VARCHAR), '')")


# cleaning and chunks

_PAGE = s_strip("l")
_CLEAN = f"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(coalesce(t, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), chr(10)),
  lambda x, i: CASE WHEN i > 1 AND i < len(string_split(coalesce(t, ''), chr(10))) AND regexp_full_match(x, '[ \\t]+') THEN '' ELSE x END), chr(10)),
  '([a-zA-Z])-\\n([a-zA-Z])', '\\1\\2', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"""


def _clean_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, {s_strip("array_to_string(list_filter(string_split(c, chr(10)), lambda l: NOT regexp_full_match(" + _PAGE + ", '[—\\-－]?\\s*\\d+\\s*[—\\-－]?')), chr(10))")} AS cleaned
FROM (SELECT {key}, {_CLEAN} AS c FROM {source})"""


@query(_clean_sql("(SELECT doc_id, text AS t FROM documents)", "doc_id"))
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(_clean_sql(values("texts"), "id"))
def page_number_lines(spark, sf_dir):
    return spread(spark, sf_dir, "texts").select("id", tx.clean(F.col("t")).alias("cleaned"))


@query(f"""SELECT id, array_to_string(list_transform(string_split(t, chr(10)), lambda l: CASE
  WHEN length({s_strip('l')}) < 50 AND regexp_matches({s_strip('l')}, '^第[一二三四五六七八九十百千万0-9]+[章节篇部分条]\\s+') THEN '# ' || {s_strip('l')}
  WHEN length({s_strip('l')}) < 50 AND regexp_matches({s_strip('l')}, '^([一二三四五六七八九十]+|[0-9]+)\\s*、') THEN '## ' || {s_strip('l')}
  WHEN length({s_strip('l')}) < 50 AND regexp_matches({s_strip('l')}, '^（[一二三四五六七八九十]+）|^[0-9]+\\.([^0-9]|$)') THEN '### ' || {s_strip('l')}
  ELSE l END), chr(10)) AS marked FROM {values('texts')}""")
def markdown_headers(spark, sf_dir):
    return spread(spark, sf_dir, "texts").select("id", tx.mark_headers(F.col("t")).alias("marked"))


_SECTIONS = f"(SELECT doc_id, i AS pos, s AS raw, {s_strip('s')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
_PACKED = f"""WITH RECURSIVE raw AS {_SECTIONS},
 cum AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) AS chars FROM raw),
 sec AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, length(s) AS n FROM cum WHERE s <> ''),
 fold AS (SELECT doc_id, k, n + 2 AS cur, 0 AS chunk FROM sec WHERE k = 1
  UNION ALL SELECT sec.doc_id, sec.k, CASE WHEN fold.cur + sec.n < 800 THEN fold.cur + sec.n + 2 ELSE sec.n + 2 END, CASE WHEN fold.cur + sec.n < 800 THEN fold.chunk ELSE fold.chunk + 1 END FROM fold JOIN sec ON sec.doc_id = fold.doc_id AND sec.k = fold.k + 1),
 part AS (SELECT sec.doc_id, sec.k, sec.s, sec.chars, fold.chunk FROM sec JOIN fold USING (doc_id, k)),
 made AS (SELECT doc_id, chunk, string_agg(s, chr(10) || chr(10) ORDER BY k) AS content, max(k) AS last_k FROM part GROUP BY ALL),
 total AS (SELECT doc_id, max(chars) AS chars FROM cum GROUP BY ALL),
 chunk_rows AS (SELECT m.doc_id, CAST(m.chunk AS BIGINT) AS pos, m.doc_id || '_' || m.chunk AS chunk_id, m.content, CAST(coalesce(p.chars, t.chars) // 800 + 1 AS BIGINT) AS page
  FROM made m LEFT JOIN part p ON p.doc_id = m.doc_id AND p.k = m.last_k + 1 JOIN total t ON t.doc_id = m.doc_id)"""


def _chunk_rows(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", tx.lines(F.col("text")))


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections, CAST(sum(length(s)) AS BIGINT) AS chars FROM {_SECTIONS} WHERE s <> '' GROUP BY doc_id")
def sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("s")).withColumn("s", tx.strip(F.col("s"))).where("s != ''")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("s").cast("bigint")).alias("chars"))


@query(_PACKED + " SELECT doc_id, pos, chunk_id, CAST(length(content) AS BIGINT) AS chars, md5(content) AS digest FROM chunk_rows")
def chunk_pack(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("doc_id", "pos", "chunk_id", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


@query(_PACKED + " SELECT doc_id, pos, page FROM chunk_rows")
def chunk_pages(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("doc_id", "pos", "page")


@query(f"""WITH s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(t, '(\\n#{{1,4}} |\\n\\n)', chr(1) || '\\1', 'g'), chr(1)), lambda x: {s_strip('x')}), lambda x: x <> '') AS p FROM {values('texts')})
 SELECT id, CAST(0 AS BIGINT) AS pos, array_to_string(p, chr(10) || chr(10)) AS content, coalesce(list_filter(list_transform(p, lambda x: {s_strip("regexp_extract(x, '^#{1,6}[ \\t\\n]+([^\\n]+)', 1)")}), lambda h: h <> '')[-1], '') AS header FROM s WHERE len(p) > 0""")
def chunk_headers(spark, sf_dir):
    return chunking.chunks(spread(spark, sf_dir, "texts"), "id", tx.sections(F.col("t"))).select("id", "pos", "content", "header")


@query(_PACKED + f" SELECT doc_id, left({s_strip('translate(content, chr(35) || chr(42) || chr(10), chr(0))')}, 100) || '...' AS summary FROM chunk_rows WHERE pos = 0".replace("translate(content, chr(35) || chr(42) || chr(10), chr(0))", "replace(replace(replace(content, chr(35), ''), chr(42), ''), chr(10), '')"))
def chunk_summary(spark, sf_dir):
    return chunking.summaries(_chunk_rows(spark, sf_dir), "doc_id")


@query(_PACKED + " SELECT CAST(count(*) AS BIGINT) AS n_chunks, round(avg(length(content)), 6) AS mean_length, round(avg(CASE WHEN length(content) < 50 THEN 1.0 ELSE 0.0 END), 6) AS short_share FROM chunk_rows")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(_chunk_rows(spark, sf_dir))


@query(f"""WITH i AS {values('images')}, t AS (SELECT *, CASE WHEN kind = 'text' THEN content END AS x FROM i),
 n AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(x IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t)
 SELECT doc, pos, content, coalesce(right(b, 3), '') || coalesce(left(a, 3), '') AS nearby FROM n WHERE kind = 'image'""")
def image_anchor_context(spark, sf_dir):
    return chunking.image_context(spread(spark, sf_dir, "images"), "doc", "pos", 3)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, 'status: ' || o_orderstatus || ' | priority: ' || o_orderpriority AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
 SELECT o_custkey, CAST((k - 1) // 3 AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS n_rows, string_agg(line, chr(10) ORDER BY o_orderkey) AS content FROM r GROUP BY o_custkey, (k - 1) // 3""")
def kv_row_chunks(spark, sf_dir):
    line = tx.key_values([("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))])
    return chunking.row_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3, line)


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
 SELECT n_regionkey, CAST((k - 1) // 3 AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS n_rows, string_agg(line, chr(10) ORDER BY n_nationkey) AS content FROM r GROUP BY ALL""")
def markdown_row_chunks(spark, sf_dir):
    return chunking.row_groups(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", 3, tx.table_row(F.col("n_nationkey"), F.col("n_name")))


@query("""WITH c AS (SELECT n_regionkey, string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY ALL)
 SELECT n_regionkey, CAST(i AS BIGINT) AS pos, substring(t, i * 20 + 1, 20) AS content FROM c, range(0, 50) r(i) WHERE i * 20 < length(t)""")
def csv_slices(spark, sf_dir):
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name")
    whole = chunking.row_groups(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", 10_000, line)
    return chunking.slices(whole, "n_regionkey", F.col("content"), 20)


@query(f"SELECT page_no, CASE WHEN length({s_strip('text')}) >= 50 THEN 'text' WHEN has_table OR (img_w > 400 AND img_h > 400) THEN 'vision' ELSE 'text' END AS route FROM {values('pdf_pages')}")
def pdf_page_route(spark, sf_dir):
    return chunking.page_route(spread(spark, sf_dir, "pdf_pages"))


@query(f"""WITH j AS (SELECT page, pos, {s_strip("regexp_replace(regexp_replace(block, '([\\x{4e00}-\\x{9fa5}])\\n+([\\x{4e00}-\\x{9fa5}])', '\\1\\2', 'g'), '\\n+', ' ', 'g')")} AS b FROM {values('pdf_blocks')})
 SELECT page, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS text FROM j WHERE b <> '' GROUP BY page""")
def pdf_block_join(spark, sf_dir):
    got = spread(spark, sf_dir, "pdf_blocks").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("x"))
    return got.select("page", tx.pdf_join(F.transform("x", lambda s: s["block"])).alias("text"))


@query("""SELECT page_id, CAST(length(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')) AS BIGINT) AS chars,
 CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages""")
def html_pages_text(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.length(bare).cast("bigint").alias("chars"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


# distinct rows


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def md5_dedup(spark, sf_dir):
    return metadata.first_uploads(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest")), F.col("digest"), "doc_id")


@query(f"SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {s_strip('text')} ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1 OR {s_strip('text')} = ''")
def content_dedup(spark, sf_dir):
    return retrieval.content_dedup(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), "text", [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "n_chars")


@query("SELECT source, min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# keyword and vector search

_WORDS = "(SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS toks FROM documents)"
_Q = ", ".join(f"'{t}'" for t in TERMS)


def _bm25_sql(where: str = "") -> str:
    return f"""WITH d AS (SELECT doc_id, toks, len(toks) AS dl FROM {_WORDS} {where}), q AS (SELECT unnest([{_Q}]) AS tok),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), p AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS tok FROM d) WHERE tok IN ({_Q}) GROUP BY ALL),
 f AS (SELECT tok, count(*) AS df FROM p GROUP BY ALL),
 bm25 AS (SELECT d.doc_id, coalesce(sum(ln(greatest(1.0, (st.n - f.df + 0.5) / (f.df + 0.5))) * p.tf / (1.5 * (1 - 0.75 + 0.75 * d.dl / st.avgdl) + p.tf)), 0.0) AS score FROM d CROSS JOIN st LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN f ON f.tok = p.tok GROUP BY d.doc_id)"""


@query(f"""WITH d AS (SELECT doc_id, toks, len(toks) AS dl FROM {_WORDS}), f AS (SELECT tok, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS tok FROM d) GROUP BY tok)
 SELECT tok, CAST(df AS BIGINT) AS df, CAST((SELECT count(*) FROM d) AS BIGINT) AS n, round((SELECT avg(dl) FROM d), 6) AS avgdl FROM f""")
def bm25_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = retrieval.document_frequencies(docs, "text")
    whole = retrieval.lengths(docs, "doc_id", "text").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return df.crossJoin(F.broadcast(whole))


@query(f"SELECT doc_id, tok, CAST(count(*) AS BIGINT) AS tf, CAST(max(dl) AS INTEGER) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS tok FROM {_WORDS}) GROUP BY doc_id, tok")
def bm25_postings(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_bm25_sql() + " SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    got = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return got.orderBy(F.col("score").desc(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("WHERE lang = 'en'") + " SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_file_scoped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return retrieval.bm25(docs, "doc_id", "text", TERMS).select("doc_id", F.round("score", 6).alias("score"))


#: The query vector of the checks: a fixed direction.
DIRECTION = [round(((k * 37) % 64 - 32) / 256, 6) for k in range(64)]
_DIST = f"list_sum(list_transform(list_zip(embedding, {DIRECTION}), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


def _nearest(spark, sf_dir, k=16, where="true"):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings").where(where), "vec_id", "embedding", DIRECTION, k)


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 16")
def vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings WHERE label IN (1, 3) ORDER BY {_DIST}, vec_id LIMIT 8")
def vector_topk_filtered(spark, sf_dir):
    return _nearest(spark, sf_dir, 8, "label IN (1, 3)").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(exp(-d), 6) AS exponential, round(1 / (1 + d), 6) AS inverse FROM (SELECT vec_id, {_DIST} AS d FROM embeddings)")
def distance_scores(spark, sf_dir):
    d = tx.squared_distance(tx.doubles(F.col("embedding")), F.array(*map(F.lit, DIRECTION)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", d.alias("d"))
    return rows.select("vec_id", F.round(tx.distance_score(F.col("d")), 6).alias("exponential"), F.round(tx.distance_score(F.col("d"), False), 6).alias("inverse"))


_HYBRID = _bm25_sql() + f""", vec AS (SELECT vec_id AS doc_id, {_DIST} AS distance FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY distance, doc_id LIMIT 16),
 best AS (SELECT doc_id FROM bm25 ORDER BY score DESC, doc_id LIMIT 24), keys AS (SELECT doc_id FROM vec UNION SELECT doc_id FROM best),
 cand AS (SELECT k.doc_id, v.distance, CASE WHEN v.distance IS NULL THEN 0.0 ELSE exp(-v.distance) END AS vector_score, coalesce(b.score, 0.0) AS bm25_score FROM keys k LEFT JOIN vec v USING (doc_id) LEFT JOIN bm25 b USING (doc_id)),
 ranked AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY vector_score DESC, doc_id)) AS part FROM cand WHERE vector_score > 0 OR distance IS NOT NULL
  UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY bm25_score DESC, doc_id)) FROM cand WHERE bm25_score > 0),
 fused AS (SELECT c.doc_id, coalesce(sum(r.part), 0.0) AS hybrid_score FROM cand c LEFT JOIN ranked r USING (doc_id) GROUP BY c.doc_id)"""


def _candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    near = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    vector = retrieval.vector_topk(near, "doc_id", "embedding", DIRECTION)
    return retrieval.merge_candidates(vector, retrieval.bm25(docs, "doc_id", "text", TERMS), "doc_id")


def _fused(spark, sf_dir):
    cand = _candidates(spark, sf_dir)
    lists = [cand.where("vector_score > 0 OR distance IS NOT NULL").select("doc_id", F.col("vector_score").alias("score")), cand.where("bm25_score > 0").select("doc_id", F.col("bm25_score").alias("score"))]
    return cand.select("doc_id").join(retrieval.rrf(lists, "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("hybrid_score", F.lit(0.0)).alias("hybrid_score"))


@query(_HYBRID + " SELECT doc_id, round(hybrid_score, 6) AS hybrid_score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query(_HYBRID + " SELECT f.doc_id, round(f.hybrid_score, 6) AS hybrid_score, d.lang FROM fused f JOIN documents d USING (doc_id) ORDER BY f.hybrid_score DESC, f.doc_id LIMIT 8")
def hybrid_topk(spark, sf_dir):
    best = _fused(spark, sf_dir).orderBy(F.col("hybrid_score").desc(), "doc_id").limit(8)
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(best), "doc_id").select("doc_id", F.round("hybrid_score", 6).alias("hybrid_score"), "lang")


@query(f"""WITH s AS {values('scored')}, e AS (SELECT min(vector_score) AS v0, max(vector_score) AS v1, min(bm25_score) AS b0, max(bm25_score) AS b1 FROM s)
 SELECT id, round(CASE WHEN n_tokens > 5 THEN 0.7 ELSE 0.4 END * (vector_score - v0) / (v1 - v0) + CASE WHEN n_tokens > 5 THEN 0.3 ELSE 0.6 END * (bm25_score - b0) / (b1 - b0), 6) AS hybrid_score FROM s, e""")
def linear_fusion(spark, sf_dir):
    rows = spread(spark, sf_dir, "scored")
    return retrieval.linear_fusion(rows, *retrieval.adaptive_weights(F.col("n_tokens"))).select("id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query(f"SELECT doc_id, CASE WHEN len(toks) > 5 THEN 0.7 ELSE 0.4 END::DOUBLE AS vector_weight, CASE WHEN len(toks) > 5 THEN 0.3 ELSE 0.6 END::DOUBLE AS bm25_weight FROM {_WORDS}")
def adaptive_weights(spark, sf_dir):
    n = F.size(tx.tokens(F.lower(F.col("text"))))
    v, b = retrieval.adaptive_weights(n)
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("vector_weight"), b.alias("bm25_weight"))


_UNIT = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_QN = sum(x * x for x in DIRECTION) ** 0.5


@query(f"""WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_UNIT}) AS v FROM (SELECT * FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 16)),
 rel AS (SELECT vec_id, v, list_sum(list_transform(list_zip(v, {DIRECTION}), lambda p: p[1] * p[2])) / {_QN!r} AS r FROM n),
 sim AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS s FROM n a, n b),
 step AS (SELECT CAST(1 AS BIGINT) AS place, [vec_id] AS picked, vec_id FROM (SELECT vec_id FROM rel ORDER BY round(0.7 * r, 12) DESC, vec_id LIMIT 1)
  UNION ALL SELECT place + 1, list_append(picked, nxt), nxt FROM (SELECT place, picked, (SELECT vec_id FROM rel WHERE NOT list_contains(picked, vec_id) ORDER BY round(0.7 * r - 0.3 * (SELECT max(s) FROM sim WHERE sim.a = rel.vec_id AND list_contains(picked, sim.b)), 12) DESC, vec_id LIMIT 1) AS nxt FROM step WHERE place < 16))
 SELECT vec_id, place FROM step""")
def mmr_order(spark, sf_dir):
    near = _nearest(spark, sf_dir).select("vec_id")
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(near), "vec_id")
    return retrieval.mmr(rows, "vec_id", "embedding", DIRECTION)


_CONF = "CASE WHEN m IS NULL THEN -1.0 ELSE round(greatest(0.15, least(0.95, 0.15 + least(1.0, greatest(m, t * 0.9) / 0.048) * 0.8)), 2) END"


@query(_HYBRID + f" SELECT CAST({_CONF} AS DOUBLE) AS confidence FROM (SELECT avg(hybrid_score) AS m, max(hybrid_score) AS t FROM (SELECT hybrid_score FROM fused ORDER BY hybrid_score DESC, doc_id LIMIT 8))")
def confidence(spark, sf_dir):
    best = _fused(spark, sf_dir).orderBy(F.col("hybrid_score").desc(), "doc_id").limit(8)
    return best.agg(F.avg("hybrid_score").alias("m"), F.max("hybrid_score").alias("t")).select(retrieval.confidence(F.col("m"), F.col("t")).alias("confidence"))


@query(f"SELECT CAST(round(least(avg(vector_score) * 1.2, 1.0), 2) AS DOUBLE) AS confidence FROM {values('scored')}")
def confidence_stream(spark, sf_dir):
    return spread(spark, sf_dir, "scored").agg(retrieval.stream_confidence(F.avg("vector_score")).alias("confidence"))


@query(f"WITH s AS {values('scored')}, e AS (SELECT min(bm25_score) AS lo, max(bm25_score) AS hi FROM s) SELECT id, CAST(floor(36 + 58 * (bm25_score - lo) / (hi - lo) + 0.5) AS DOUBLE) AS relevance FROM s, e")
def relative_relevance(spark, sf_dir):
    return retrieval.relative_relevance(spread(spark, sf_dir, "scored"), "bm25_score").select("id", "relevance")


@query("SELECT o_orderkey, CAST(CASE WHEN n < 1 THEN greatest(32, least(88, floor(lo * 1600 + 0.5))) ELSE floor(36 + 58 * (s - lo) / (hi - lo) + 0.5) END AS DOUBLE) AS relevance FROM (SELECT o_orderkey, o_totalprice AS s, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi, max(o_totalprice) OVER () - min(o_totalprice) OVER () AS n FROM orders)")
def relative_relevance_orders(spark, sf_dir):
    return retrieval.relative_relevance(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "relevance")


@query("SELECT n_nationkey, CAST(48.0 AS DOUBLE) AS relevance FROM nation")
def relative_relevance_flat(spark, sf_dir):
    return retrieval.relative_relevance(table(spark, sf_dir, "nation").withColumn("score", F.lit(0.03)), "score").select("n_nationkey", "relevance")


@query("""WITH w AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
 SELECT conv_id, turn, CASE WHEN length(text) + 2 <= 400 - b THEN text ELSE left(text, CAST(400 - b AS BIGINT)) END AS part FROM w WHERE length(text) + 2 <= 400 - b OR 400 - b > 50""")
def context_budget(spark, sf_dir):
    return retrieval.context_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn", "part")


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN instr(reverse(left(text, 300)), chr(10)) > 0 AND 300 - instr(reverse(left(text, 300)), chr(10)) >= 200
 THEN left(text, 300 - instr(reverse(left(text, 300)), chr(10)) + 1) ELSE left(text, 300) || '…' END AS cut FROM documents""")
def sentence_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.cut_at_sentence(F.col("text"), 300).alias("cut"))


@query(f"""SELECT id, {s_strip("array_to_string(list_filter(string_split(regexp_replace(regexp_replace(t, '^.*?回答[:：]', '', 's'), '来源[:：].*$', '', 's'), chr(10)), lambda l: NOT regexp_matches(" + s_strip('l') + ", '^(问题|文档内容|要求)[:：]')), chr(10))")} AS answer FROM {values('answers')}""")
def answer_normalise(spark, sf_dir):
    return spread(spark, sf_dir, "answers").select("id", tx.normal_answer(F.col("t")).alias("answer"))


# terms of texts without spaces

_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


@query(f"""WITH r AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[{_HAN}]+|[a-z0-9_]{{2,}}')) AS r FROM {values('chunks')}),
 t AS (SELECT chunk_id, unnest(CASE WHEN regexp_matches(r, '[{_HAN}]') THEN list_transform(range(1, greatest(length(r), 2)), lambda i: r[i:i + 1]) ELSE [r] END) AS tok FROM r)
 SELECT chunk_id, tok, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY chunk_id, tok""")
def cjk_terms(spark, sf_dir):
    rows = spread(spark, sf_dir, "chunks").select("chunk_id", F.explode(tx.tokens(F.lower(F.col("content")))).alias("tok"))
    return rows.groupBy("chunk_id", "tok").agg(F.count(F.lit(1)).alias("n"))


# conflicts


def _conflict_sql(kinds: list[tuple[str, str, int]], having: str) -> str:
    parts = " UNION ALL ".join(f"SELECT g, '{kind}' AS kind, chunk_id, source_file, {s_strip('x')} AS value FROM (SELECT g, chunk_id, source_file, unnest(regexp_extract_all(content, '{pattern}', 1)) AS x FROM c) WHERE length({s_strip('x')}) >= {least}" for kind, pattern, least in kinds)
    return f"""WITH c AS {values('chunks', True)}, v AS ({parts}), k AS (SELECT g, kind FROM v GROUP BY g, kind HAVING count(DISTINCT value) >= 2 AND {having}),
 found AS (SELECT g, kind, value, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(chunk_id)), ',') AS chunks FROM v SEMI JOIN k USING (g, kind) GROUP BY g, kind, value)"""


_MONEY_SQL = _conflict_sql([("金额", p, 2) for p in conflicts.MONEY], "true")


@query(_MONEY_SQL + " SELECT * FROM found")
def conflicts_money(spark, sf_dir):
    return conflicts.money(spread(spark, sf_dir, "chunks", True), ["g"])


_DAYS, _MONTHS, _YEARS = (r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})"), (r"([0-9]{4}年[0-9]{1,2}月)", r"([0-9]{4}-[0-9]{2})"), (r"([0-9]{4}年)",)
_DATES_SQL = [(kind, p, 4) for kind, ps in (("日期(签订/生效日期)", _DAYS), ("日期(年月)", _MONTHS), ("日期(年份)", _YEARS)) for p in ps]


@query(_conflict_sql(_DATES_SQL, "count(DISTINCT chunk_id) >= 2") + " SELECT * FROM found")
def conflicts_dates(spark, sf_dir):
    return conflicts.dates(spread(spark, sf_dir, "chunks", True), ["g"])


@query(_conflict_sql([("比例", p, 2) for p in conflicts.RATIO], "count(DISTINCT value) <= 6") + " SELECT * FROM found WHERE g IN (SELECT g FROM c GROUP BY g HAVING count(DISTINCT source_file) >= 2)")
def conflicts_ratio(spark, sf_dir):
    return conflicts.ratios(spread(spark, sf_dir, "chunks", True), ["g"])


@query(_conflict_sql([("公司名", p, 4) for p in conflicts.COMPANY], "true") + " SELECT * FROM found")
def conflicts_company(spark, sf_dir):
    return conflicts.companies(spread(spark, sf_dir, "chunks", True), ["g"])


@query(_MONEY_SQL + ", h AS (SELECT DISTINCT g, unnest(string_split(chunks, ',')) AS chunk_id, kind FROM found) SELECT c.g, c.chunk_id, count(h.kind) > 0 AS has_conflict, coalesce(string_agg(h.kind, ',' ORDER BY h.kind), '') AS kinds FROM c LEFT JOIN h USING (g, chunk_id) GROUP BY c.g, c.chunk_id")
def conflict_annotate(spark, sf_dir):
    rows = spread(spark, sf_dir, "chunks", True)
    return conflicts.annotate(rows, conflicts.money(rows, ["g"]), ["g"])


# conditions

_ORDERS = "o_orderkey, o_orderstatus, o_orderpriority"


def _where(spark, sf_dir, name, groups, *columns):
    df = table(spark, sf_dir, name)
    return df.where(predicates.any_of(df, groups)).select(*columns)


def _one(col, op, v1="", v2=""):
    return [[{"col": col, "op": op, "v1": v1, "v2": v2}]]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return _where(spark, sf_dir, "orders", _one("o_orderstatus", "eq", "F"), "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE coalesce(c_mktsegment, '') <> 'BUILDING'")
def filter_neq(spark, sf_dir):
    return _where(spark, sf_dir, "customer", _one("c_mktsegment", "neq", "BUILDING"), "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e')")
def filter_contains(spark, sf_dir):
    return _where(spark, sf_dir, "part", _one("p_name", "contains", "e"), "p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE NOT contains(coalesce(p_type, ''), 'A')")
def filter_not_contains(spark, sf_dir):
    return _where(spark, sf_dir, "part", _one("p_type", "not_contains", "A"), "p_partkey")


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 GROUP BY l_orderkey")
def filter_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    cond = predicates.any_of(df, [[{"col": "l_quantity", "op": "gt", "v1": "30"}, {"col": "l_discount", "op": "lte", "v1": "0.05"}]])
    return df.where(cond).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 5000")
def filter_between_num(spark, sf_dir):
    return _where(spark, sf_dir, "customer", _one("c_acctbal", "between", "100", "5000"), "c_custkey", "c_acctbal")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def filter_between_date(spark, sf_dir):
    return _where(spark, sf_dir, "events", _one("ts", "between", "2024-01-05", "2024/1/9 12:00"), "event_id")


@query(f"SELECT ord FROM {values('people')} WHERE {s_text('city')} = ''")
def filter_empty(spark, sf_dir):
    df = spread(spark, sf_dir, "people")
    return df.where(predicates.any_of(df, _one("city", "empty"))).select("ord")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 50000)")
def filter_or_groups(spark, sf_dir):
    groups = [[{"col": "o_orderstatus", "op": "eq", "v1": "F"}, {"col": "o_totalprice", "op": "gt", "v1": "200000"}], [{"col": "o_orderpriority", "op": "eq", "v1": "1-URGENT"}, {"col": "o_totalprice", "op": "lt", "v1": "50000"}]]
    return _where(spark, sf_dir, "orders", groups, "o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def filter_missing_col(spark, sf_dir):
    return _where(spark, sf_dir, "supplier", [[{"col": "no such column", "op": "eq", "v1": "x"}, {"col": "s_acctbal", "op": "gt", "v1": "0"}]], "s_suppkey")


@query("SELECT event_id FROM events WHERE left(strftime(ts, '%Y-%m-%d %H:%M:%S'), 16) = '2024-01-10 00:00' OR (SELECT count(*) FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') = '2024-01-10 00:00:99') > 0")
def filter_fuzzy_time(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return predicates.fuzzy_time(df, "t", "2024-01-10 00:00:99").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'O' AND contains(o_orderpriority, 'HIGH')")
def filter_nl_rules(spark, sf_dir):
    return _where(spark, sf_dir, "orders", [predicates.parse_rules("o_totalprice大于等于100000，o_orderstatus不等于O且o_orderpriority包含HIGH")], "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT contains(c_name, '00') AND NOT contains(c_mktsegment, '00')")
def filter_include_exclude(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    got = predicates.include_exclude(df, "只要c_mktsegment是BUILDING的，不要00的")
    return (df if got is None else got).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def cond_filter(spark, sf_dir):
    return predicates.conditional_filter(table(spark, sf_dir, "part"), "p_size", ">40").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 1000)")
def cond_delete(spark, sf_dir):
    return predicates.conditional_delete(table(spark, sf_dir, "supplier"), "s_acctbal", "<1000").select("s_suppkey")


@query(f"SELECT sheet, row, col, CASE WHEN TRY_CAST(value AS DOUBLE) >= 100 THEN 'FF0000' END AS style FROM {values('sheet')}")
def cond_format(spark, sf_dir):
    return predicates.conditional_style(spread(spark, sf_dir, "sheet"), ">=100", "FF0000").select("sheet", "row", "col", "style")


@query("SELECT CAST((SELECT count(*) FROM part WHERE p_size = 7) AS BIGINT) AS n, coalesce((SELECT string_agg(k, ',' ORDER BY p) FROM (SELECT p_partkey AS p, CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 50)), '') AS first_keys")
def cond_preview(spark, sf_dir):
    return predicates.preview(table(spark, sf_dir, "part"), "p_size", "==7", "p_partkey")


@query(f"SELECT sheet, row, col FROM {values('sheet')} WHERE contains(coalesce(value, ''), '国')")
def find_cells(spark, sf_dir):
    return predicates.find_cells(spread(spark, sf_dir, "sheet"), "国").select("sheet", "row", "col")


# reshaping and filling


@query("SELECT 'customer' AS source_file, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def merge_vertical(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.merge_vertical([("customer", c), ("supplier", s)])


@query("SELECT CAST(coalesce(n.k, r.k) AS BIGINT) AS ordinal, n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) n FULL JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) r ON n.k = r.k")
def merge_horizontal(spark, sf_dir):
    return tables.merge_horizontal(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "region"), "r_regionkey").select("ordinal", "n_name", "r_name")


@query("SELECT conv_id, string_agg('# ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id")
def merge_markdown(spark, sf_dir):
    return tables.merge_markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "text")


@query("SELECT part, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS part FROM orders) GROUP BY part")
def split_rows(spark, sf_dir):
    return tables.split_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def stack_tables(spark, sf_dir):
    parts = [table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "supplier").select("s_suppkey")]
    return tables.stack_matching(parts, ["N Name", "r_name"])


_NORM = "lower(replace(replace(replace(replace({}, ' ', ''), '_', ''), '/', ''), chr(92), ''))"


@query(f"SELECT f.field, (SELECT min_by(name, ord) FROM {values('headers')} h WHERE {_NORM.format('h.name')} = {_NORM.format('f.field')}) AS name FROM {values('fields')} f")
def field_match(spark, sf_dir):
    return tables.match_fields(spread(spark, sf_dir, "fields"), spread(spark, sf_dir, "headers"))


@query(f"""WITH p AS (SELECT h.name AS header, f.field, CASE WHEN {_NORM.format('h.name')} = {_NORM.format('f.field')} THEN 3 WHEN contains({_NORM.format('f.field')}, {_NORM.format('h.name')}) THEN 2 WHEN contains({_NORM.format('h.name')}, {_NORM.format('f.field')}) THEN 1 ELSE 0 END AS score FROM {values('headers')} h, {values('fields')} f),
 r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, length(field), field) AS k FROM p)
 SELECT header, CASE WHEN score > 0 THEN field END AS field, CAST(score AS BIGINT) AS score FROM r WHERE k = 1""")
def fuzzy_field_match(spark, sf_dir):
    return tables.fuzzy_match(spread(spark, sf_dir, "headers").select(F.col("name").alias("header")), spread(spark, sf_dir, "fields"))


_PLACE = "row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)"


@query(f"WITH r AS (SELECT n_regionkey, {_PLACE} AS k, n_name, n_nationkey FROM nation) SELECT n_regionkey, CAST(k AS BIGINT) AS place, 'name' AS field, n_name AS value FROM r WHERE k <= 4 UNION ALL SELECT n_regionkey, CAST(k AS BIGINT), 'key', CAST(n_nationkey AS VARCHAR) FROM r WHERE k <= 4")
def fill_align(spark, sf_dir):
    return tables.fill_rows(table(spark, sf_dir, "nation"), "n_nationkey", {"name": "n_name", "key": "n_nationkey"}, 4, partition="n_regionkey")


@query(f"""WITH c AS (SELECT ord, unnest(['name', 'city']) AS field, unnest([{s_text('name')}, {s_text('city')}]) AS value FROM {values('people')})
 SELECT CAST(row_number() OVER (PARTITION BY field ORDER BY ord) AS BIGINT) AS place, field, value FROM c WHERE value <> ''""")
def fill_compact(spark, sf_dir):
    return tables.fill_rows(spread(spark, sf_dir, "people"), "ord", {"name": "name", "city": "city"}, compact=True)


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM {values('people')}), c AS (SELECT place, {s_text('name')} AS value FROM r WHERE {s_text('name')} <> '')
 SELECT CAST(place + 2 AS BIGINT) AS row, CAST(1 AS BIGINT) AS col, value FROM c UNION ALL SELECT CAST(place + 2 AS BIGINT), CAST(3 AS BIGINT), 'only' FROM (SELECT unnest(range(1, (SELECT max(place) FROM c) + 1)) AS place)""")
def fill_grid(spark, sf_dir):
    cells = tables.fill_rows(spread(spark, sf_dir, "people"), "ord", {"name": "name"}).where("value != ''")
    single = spark.createDataFrame([(1, "note", "only")], "place bigint, field string, value string")
    heads = spark.createDataFrame([("name", 1), ("note", 3)], "field string, col bigint")
    return tables.fill_grid(cells.unionByName(single), heads, 2)


@query(f"""WITH s AS {values('slots')}, e AS (SELECT tbl, row, row_number() OVER (PARTITION BY tbl ORDER BY row) AS place FROM s WHERE is_empty), l AS (SELECT tbl, max(row) AS last, count(*) FILTER (is_empty) AS free FROM s GROUP BY tbl)
 SELECT v.tbl, v.place, v.value, CAST(coalesce(e.row, l.last + v.place - l.free) AS BIGINT) AS row FROM {values('slot_values')} v JOIN l USING (tbl) LEFT JOIN e ON e.tbl = v.tbl AND e.place = v.place""")
def fill_docx_rows(spark, sf_dir):
    return tables.docx_rows(spread(spark, sf_dir, "slots"), spread(spark, sf_dir, "slot_values"))


@query(f"""WITH h AS (SELECT p.ordinal, p.text, a.value, row_number() OVER (PARTITION BY p.ordinal ORDER BY length(a.field) DESC, a.field) AS rn FROM {values('labels_t')} p LEFT JOIN {values('label_values')} a ON suffix(regexp_replace({s_strip('p.text')}, '[：:]$', ''), a.field))
 SELECT ordinal, text || coalesce(value, '') AS text FROM h WHERE rn = 1""")
def label_fill(spark, sf_dir):
    return tables.fill_labels(spread(spark, sf_dir, "labels_t"), spread(spark, sf_dir, "label_values"))


@query(f"SELECT DISTINCT id, {s_strip('x')} AS field FROM (SELECT id, unnest(regexp_extract_all(t, '\\{{\\{{([^{{}}]+)\\}}\\}}', 1)) AS x FROM {values('templates')})".replace("\\\\", "\\"))
def placeholder_extract(spark, sf_dir):
    return spread(spark, sf_dir, "templates").select("id", F.explode(tables.placeholders(F.col("t"))).alias("field"))


@query(f"SELECT id, replace(replace(t, '{{{{甲方}}}}', '星海'), '{{{{a}}}}', '1') AS t FROM {values('templates')}")
def placeholder_replace(spark, sf_dir):
    return spread(spark, sf_dir, "templates").select("id", tables.replace_placeholders(F.col("t"), {"甲方": "星海", "a": "1"}).alias("t"))


@query(f"SELECT sheet, row, CAST(count(*) AS BIGINT) AS filled FROM {values('sheet')} WHERE {s_text('value')} <> '' GROUP BY ALL HAVING count(*) >= 3 ORDER BY filled DESC, sheet, row LIMIT 1")
def header_row(spark, sf_dir):
    return tables.header_row(spread(spark, sf_dir, "sheet"))


_KV = r"^\s*([^：:]{1,15})[：:]\s*(.+)$"


@query(f"""WITH l AS (SELECT id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM {values('kv')}), k AS (SELECT *, {s_strip(f"regexp_extract(l, '{_KV}', 1)")} AS k, {s_strip(f"regexp_extract(l, '{_KV}', 2)")} AS v FROM l)
 SELECT id, CAST(line AS BIGINT) AS line, CASE WHEN contains(k, '国家') OR contains('国家', k) THEN '国家' WHEN contains(k, '人口') OR contains('人口', k) THEN '人口' ELSE 'GDP' END AS field,
 {s_strip("replace(regexp_replace(regexp_replace(v, '[（(][^）)]*[）)]', '', 'g'), '(亿元|万元|千元|亿|万|元|人|例|%)$', ''), ',', '')")} AS value FROM k WHERE k <> '' AND (contains(k, '国家') OR contains('国家', k) OR contains(k, '人口') OR contains('人口', k) OR contains(k, 'GDP') OR contains('GDP', k))""")
def kv_extract(spark, sf_dir):
    return tables.key_value_lines(spread(spark, sf_dir, "kv"), "id", "t", ["国家", "人口", "GDP"])


@query(f"""WITH p AS (SELECT *, (CASE WHEN {s_text('name')} <> '' THEN 1 ELSE 0 END) + (CASE WHEN {s_text('city')} <> '' THEN 1 ELSE 0 END) + (CASE WHEN {s_text('age')} <> '' THEN 1 ELSE 0 END) AS n FROM {values('people')}),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, ord) AS rn FROM p) SELECT ord, name, city, age FROM r WHERE rn = 1 OR {s_text('name')} = ''""")
def dedup_fullest(spark, sf_dir):
    return tables.keep_fullest(spread(spark, sf_dir, "people"), "name", "ord")


# sheets and paragraphs


@query(f"SELECT sheet, row, col, CASE WHEN e.sheet IS NOT NULL THEN e.value ELSE c.value END AS value FROM {values('sheet')} c FULL JOIN {values('edits')} e USING (sheet, row, col)".replace("e.sheet IS NOT NULL", "e.value IS NOT NULL"))
def cell_edit(spark, sf_dir):
    return sheets.edit_cells(spread(spark, sf_dir, "sheet"), spread(spark, sf_dir, "edits"))


@query(f"SELECT sheet, CAST(CASE WHEN sheet = 's1' AND row >= 3 THEN row + 1 ELSE row END AS BIGINT) AS row, col, value FROM {values('sheet')} UNION ALL SELECT 's1', 3, 1, 'x' UNION ALL SELECT 's1', 3, 2, 'y'")
def row_insert(spark, sf_dir):
    return sheets.insert_row(spread(spark, sf_dir, "sheet"), "s1", 3, ["x", "y"])


@query(f"SELECT sheet, CAST(CASE WHEN sheet = 's1' AND row > 2 THEN row - 1 ELSE row END AS BIGINT) AS row, col, value FROM {values('sheet')} WHERE NOT (sheet = 's1' AND row = 2)")
def row_delete(spark, sf_dir):
    return sheets.delete_row(spread(spark, sf_dir, "sheet"), "s1", 2)


@query(f"SELECT sheet, row, CAST(CASE WHEN sheet = 's1' AND col >= 2 THEN col + 1 ELSE col END AS BIGINT) AS col, value FROM {values('sheet')} UNION ALL SELECT 's1', 1, 2, 'new'")
def col_add(spark, sf_dir):
    return sheets.insert_column(spread(spark, sf_dir, "sheet"), "s1", 2, "new")


@query(f"SELECT sheet, row, CAST(CASE WHEN sheet = 's1' AND col > 2 THEN col - 1 ELSE col END AS BIGINT) AS col, value FROM {values('sheet')} WHERE NOT (sheet = 's1' AND col = 2)")
def col_delete(spark, sf_dir):
    return sheets.delete_column(spread(spark, sf_dir, "sheet"), "s1", 2)


@query(f"SELECT sheet, row, value FROM {values('sheet')} WHERE col = 2 AND value IS NOT NULL")
def extract_column(spark, sf_dir):
    return sheets.extract_column(spread(spark, sf_dir, "sheet"), None, 2)


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + 1 AS r FROM nation) SELECT 'nation' AS sheet, CAST(r AS BIGINT) AS row, CAST(1 AS BIGINT) AS col, CAST(n_nationkey AS VARCHAR) AS value FROM n UNION ALL SELECT 'nation', r, 2, n_name FROM n UNION ALL SELECT 'nation', 1, 1, 'n_nationkey' UNION ALL SELECT 'nation', 1, 2, 'n_name'")
def sheet_cells(spark, sf_dir):
    return sheets.to_cells(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation", "n_nationkey")


@query(f"""SELECT ref, CAST(coalesce(TRY_CAST(regexp_extract(ref, '^[A-Za-z]+([0-9]+)$', 1) AS BIGINT), TRY_CAST(regexp_extract(ref, '第([0-9]+)行', 1) AS BIGINT), TRY_CAST(regexp_extract(ref, '^([0-9]+)\\s*,', 1) AS BIGINT), 1) AS BIGINT) AS row,
 CAST(CASE WHEN regexp_matches(ref, '^[A-Za-z]+[0-9]+$') THEN list_reduce(list_prepend(0, list_transform(string_split(upper(regexp_extract(ref, '^([A-Za-z]+)', 1)), ''), lambda c: ascii(c) - 64)), lambda a, x: a * 26 + x)
 ELSE coalesce(TRY_CAST(regexp_extract(ref, '第([0-9]+)列', 1) AS BIGINT), TRY_CAST(regexp_extract(ref, '^[0-9]+\\s*,\\s*([0-9]+)$', 1) AS BIGINT), 1) END AS BIGINT) AS col FROM {values('refs')}""".replace("\\\\", "\\"))
def a1_refs(spark, sf_dir):
    return spread(spark, sf_dir, "refs").select("ref", tx.cell_row(F.col("ref")).alias("row"), tx.cell_column(F.col("ref")).alias("col"))


@query(f"""WITH p AS (SELECT n, CASE WHEN contains(n, '百') THEN split_part(n, '百', 1) ELSE '' END AS h, replace(CASE WHEN contains(n, '百') THEN split_part(n, '百', 2) ELSE n END, '零', '') AS r FROM {values('numbers')}),
 q AS (SELECT n, h, CASE WHEN contains(r, '十') THEN CASE WHEN starts_with(r, '十') THEN '一' ELSE split_part(r, '十', 1) END ELSE '' END AS t, CASE WHEN contains(r, '十') THEN split_part(r, '十', 2) ELSE r END AS u FROM p),
 d AS (SELECT n, list_transform([h, t, u], lambda x: CASE WHEN x = '' THEN 0 WHEN x = '两' THEN 2 ELSE instr('一二三四五六七八九', x) END) AS v FROM q)
 SELECT n, CASE WHEN regexp_full_match(n, '[0-9]+') THEN TRY_CAST(n AS BIGINT) WHEN regexp_full_match(n, '[一二两三四五六七八九十百零]+') AND v[1] * 100 + v[2] * 10 + v[3] > 0 THEN CAST(v[1] * 100 + v[2] * 10 + v[3] AS BIGINT) END AS value FROM d""")
def cn_numbers(spark, sf_dir):
    return spread(spark, sf_dir, "numbers").select("n", tx.chinese_number(F.col("n")).alias("value"))


@query(f"SELECT v, {s_strip("replace(regexp_replace(regexp_replace(v, '[（(][^）)]*[）)]', '', 'g'), '(亿元|万元|千元|亿|万|元|人|例|%)$', ''), ',', '')")} AS bare FROM {values('units')}")
def unit_strip(spark, sf_dir):
    return spread(spark, sf_dir, "units").select("v", tx.strip_unit(F.col("v")).alias("bare"))


@query(f"""SELECT c, CASE WHEN starts_with(c, 'rgb(') THEN array_to_string(list_transform(regexp_extract_all(c, '[0-9]+'), lambda x: printf('%02X', CAST(x AS INTEGER))), '')
 ELSE CASE lower(c) WHEN 'red' THEN 'FF0000' WHEN 'yellow' THEN 'FFFF00' WHEN '绿色' THEN '00FF00' END END AS hex FROM {values('colours')}""")
def colour_hex(spark, sf_dir):
    return spread(spark, sf_dir, "colours").select("c", tx.rgb_hex(F.col("c")).alias("hex"))


@query(f"""WITH p AS (SELECT id, regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gs'), '```[a-zA-Z]*', '', 'g') AS t FROM {values('replies')}), o AS (SELECT id, CASE WHEN instr(t, chr(123)) > 0 THEN substring(t, instr(t, chr(123))) ELSE '' END AS t FROM p)
 SELECT id, (SELECT substring(t, 1, min(i)) FROM range(1, 200) r(i) WHERE i <= length(t) AND length(replace(left(t, i), chr(123), '')) = length(replace(left(t, i), chr(125), ''))) AS json FROM o""")
def json_recover(spark, sf_dir):
    return spread(spark, sf_dir, "replies").select("id", tx.json_object(F.col("t")).alias("json"))


_KIND_SQL = f"""(SELECT *, CASE WHEN {s_strip('text')} = '' THEN 'blank' WHEN regexp_matches(coalesce(style, ''), '(?i)标题|heading|subtitle|subhead|cover') OR ordinal <= 1 OR regexp_matches({s_strip('text')}, '^(—|――)')
 OR regexp_matches({s_strip('text')}, '^(撰稿|摄影|作者|日期|时间|审核|校对)[：:]') OR (length({s_strip('text')}) < 15 AND ordinal < count(*) OVER (PARTITION BY doc_id) - 3) OR (coalesce(bold, false) AND length({s_strip('text')}) < 30) THEN 'heading' ELSE 'body' END AS kind FROM {values('paragraphs')})"""


@query(f"SELECT doc_id, ordinal, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY ordinal) AS BIGINT) AS n FROM {_KIND_SQL}")
def para_classify(spark, sf_dir):
    return sheets.numbered(spread(spark, sf_dir, "paragraphs")).select("doc_id", "ordinal", "kind", "n")


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM {_KIND_SQL} WHERE kind = 'body') SELECT doc_id, ordinal FROM n WHERE n = 2")
def para_locate(spark, sf_dir):
    return sheets.locate(spread(spark, sf_dir, "paragraphs"), "第二段").select("doc_id", "ordinal")


@query(f"SELECT doc_id, ordinal, replace(text, '预算', '经费') AS text, contains(text, '预算') AS changed FROM {values('paragraphs')}")
def para_replace(spark, sf_dir):
    return sheets.replace_text(spread(spark, sf_dir, "paragraphs"), "预算", "经费").select("doc_id", "ordinal", "text", "changed")


@query(f"SELECT doc_id, CAST(CASE WHEN doc_id = 1 AND ordinal > 4 THEN ordinal - 1 ELSE ordinal END AS BIGINT) AS ordinal, text FROM {values('paragraphs')} WHERE NOT (doc_id = 1 AND ordinal = 4)")
def para_delete(spark, sf_dir):
    return sheets.delete_paragraph(spread(spark, sf_dir, "paragraphs"), 1, 4).select("doc_id", "ordinal", "text")


@query(f"SELECT doc_id, CAST(CASE WHEN doc_id = 1 AND ordinal >= 4 THEN ordinal + 1 ELSE ordinal END AS BIGINT) AS ordinal, text FROM {values('paragraphs')} UNION ALL SELECT 1, 4, '新的一段'")
def para_insert(spark, sf_dir):
    return sheets.insert_paragraph(spread(spark, sf_dir, "paragraphs"), 1, 4, "新的一段").select("doc_id", "ordinal", "text")


@query("""WITH o AS (SELECT doc_id, text, CAST(i AS BIGINT) AS place FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 5, 1))) AS i FROM documents WHERE contains(text, 'nthst')) WHERE substring(text, i, 5) = 'nthst')
 SELECT doc_id, place, CASE WHEN place - 20 > 1 THEN '...' ELSE '' END || substring(text, greatest(place - 20, 1), least(place + 24, length(text)) - greatest(place - 20, 1) + 1) || CASE WHEN place + 24 < length(text) THEN '...' ELSE '' END AS context FROM o""")
def keyword_context(spark, sf_dir):
    return sheets.keyword_context(table(spark, sf_dir, "documents"), "doc_id", "text", "nthst", 20)


# evaluation


def _evaluated(spark, sf_dir):
    return spread(spark, sf_dir, "cases").select("id", evaluation.faithfulness(F.col("answer"), F.col("context")).alias("faithfulness"), evaluation.relevancy(F.col("query"), F.col("answer")).alias("relevancy"), evaluation.precision(F.col("query"), F.col("context")).alias("precision"), evaluation.recall(F.col("answer"), F.col("context"), F.col("truth")).alias("recall"))


_CJK = r"\x{4e00}-\x{9fa5}"
_WORDS_SQL = "list_distinct(list_filter(string_split_regex(regexp_replace({0}, '[^" + _CJK + "a-zA-Z0-9]', ' ', 'g'), ' +'), lambda x: length(x) >= 2))"
_GRAM_SQL = "list_distinct(list_filter(list_transform(range(1, greatest(length(regexp_replace({0}, '[^" + _CJK + "a-zA-Z0-9]', '', 'g')), 1)), lambda i: substring(regexp_replace({0}, '[^" + _CJK + "a-zA-Z0-9]', '', 'g'), i, 2)), lambda g: length(g) = 2))"


def _jaccard_sql(form: str) -> str:
    a, b = form.replace("{0}", "query"), form.replace("{0}", "answer")
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_EVAL_SQL = f"""WITH c AS {values('cases')}, e AS (SELECT id,
 round(CASE WHEN len(facts) = 0 THEN 1.0 ELSE len(list_filter(facts, lambda f: len(regexp_extract_all(f, '[{_CJK}]{{2,}}|[0-9]+')) > 0 AND 2 * len(list_filter(regexp_extract_all(f, '[{_CJK}]{{2,}}|[0-9]+'), lambda k: contains(context, k))) >= len(regexp_extract_all(f, '[{_CJK}]{{2,}}|[0-9]+'))))::DOUBLE / len(facts) END, 3) AS faithfulness,
 round(CASE WHEN length(answer) < 5 OR regexp_matches(answer, '无法回答|不知道|没有相关|未提及|不清楚') THEN 0.0 ELSE least(0.3 * ({_jaccard_sql(_WORDS_SQL)}) + 0.2 * ({_jaccard_sql(_GRAM_SQL)}) + 0.5 * least(len(list_filter(regexp_extract_all(answer, '[{_CJK}]{{3,20}}|[0-9]+\\.?[0-9]*[万千百亿]*|[a-zA-Z]+'), lambda x: length(x) >= 2)) / 3.0, 1.0), 1.0) END, 3) AS relevancy,
 round(CASE WHEN length(context) < 10 THEN 0.0 WHEN len(qw) > 0 AND len(list_filter(qw, lambda w: contains(context, w)))::DOUBLE / len(qw) >= 0.5 THEN len(list_filter(qw, lambda w: contains(context, w)))::DOUBLE / len(qw)
  WHEN marks > 0 THEN least(0.6 + marks * 0.05, 0.95) ELSE 0.0 END, 3) AS precision,
 round(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_filter(want, lambda w: contains(context, w)))::DOUBLE / len(want) END, 3) AS recall
 FROM (SELECT *, list_filter(list_transform(string_split_regex(answer, '[。！？\\n]'), lambda x: {s_strip('x')}), lambda x: length(x) > 5) AS facts,
  list_filter(regexp_extract_all(query, '[{_CJK}]{{2,8}}'), lambda w: NOT list_contains(['什么', '多少', '怎样', '如何', '为什么', '哪个', '哪些', '什么时候', '哪里', '谁', '几个', '怎么样', '是否', '能否'], w)) AS qw, len(list_filter(['签订', '合同', '协议', '公司', '付款', '有效', '签订日期', '金额', '日期', '期限', '服务', '甲方', '乙方', '人民币', '万元'], lambda w: contains(context, w))) AS marks,
  list_concat(regexp_extract_all(ref, '[0-9]+\\.?[0-9]*[万千百亿]?'), list_filter(regexp_extract_all(ref, '[{_CJK}]{{2,4}}'), lambda w: length(w) >= 3)[1:10]) AS want
  FROM (SELECT *, CASE WHEN coalesce(truth, '') <> '' THEN truth ELSE answer END AS ref FROM c)))""".replace("\\\\", "\\")


@query(_EVAL_SQL + " SELECT id, CAST(faithfulness AS DOUBLE) AS faithfulness FROM e")
def eval_faithfulness(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "faithfulness")


@query(_EVAL_SQL + " SELECT id, CAST(relevancy AS DOUBLE) AS relevancy FROM e")
def eval_relevancy(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "relevancy")


@query(_EVAL_SQL + " SELECT id, CAST(precision AS DOUBLE) AS precision FROM e")
def eval_precision(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "precision")


@query(_EVAL_SQL + " SELECT id, CAST(recall AS DOUBLE) AS recall FROM e")
def eval_recall(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "recall")


@query(_EVAL_SQL + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ((faithfulness + relevancy + precision + recall) / 4 >= 0.6) AS BIGINT) AS passed, round(avg(recall), 6) AS mean_recall FROM e")
def eval_summary(spark, sf_dir):
    overall = (F.col("faithfulness") + F.col("relevancy") + F.col("precision") + F.col("recall")) / 4
    return _evaluated(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum((overall >= 0.6).cast("bigint")).alias("passed"), F.round(F.avg("recall"), 6).alias("mean_recall"))


@query(f"SELECT id, CAST(round(0.7 * len(list_filter(string_split(expected, ','), lambda k: contains(answer, k))) / len(string_split(expected, ',')) + CASE WHEN n_sources > 0 THEN 0.2 ELSE 0 END + CASE WHEN confidence >= 0 THEN 0.1 ELSE 0 END, 3) AS DOUBLE) AS score FROM {values('hits')}")
def keyword_hit(spark, sf_dir):
    return spread(spark, sf_dir, "hits").select("id", evaluation.keyword_hit(F.col("answer"), F.split("expected", ","), F.col("n_sources"), F.col("confidence")).alias("score"))


# files and tasks


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("file_type"), F.col("n_chars").alias("file_size"), F.when(F.col("doc_id") % 3 == 0, "indexed").otherwise("uploaded").alias("status"))


@query("SELECT doc_id AS file_id, lang AS file_type FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id LIMIT 10 OFFSET 20")
def files_page(spark, sf_dir):
    return metadata.page(_files(spark, sf_dir), "file_id", 20, 10, F.col("status") == "indexed").select("file_id", "file_type")


@query("SELECT lang AS file_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS indexed, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def status_summary(spark, sf_dir):
    return metadata.status_summary(_files(spark, sf_dir))


@query(f"SELECT task_id, file_id FROM {values('tasks')} WHERE file_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def cascade_delete(spark, sf_dir):
    files = _files(spark, sf_dir)
    return metadata.cascade(files, spread(spark, sf_dir, "tasks"), files.where("status = 'indexed'").select("file_id"))[1].select("task_id", "file_id")


@query(f"SELECT task_id FROM {values('tasks')} WHERE status IN ('pending', 'processing')")
def active_tasks(spark, sf_dir):
    return metadata.active_tasks(spread(spark, sf_dir, "tasks")).select("task_id")


@query("SELECT doc_id AS file_id FROM documents WHERE doc_id % 3 <> 0")
def incremental_index(spark, sf_dir):
    files = _files(spark, sf_dir)
    return metadata.to_index(files, files.where("status = 'indexed'")).select("file_id")


@query(f"""SELECT file_id, replace(regexp_extract(name, '([^/\\\\]*)$', 1), '..', '') AS name, regexp_matches(lower(name), '\\.(pdf|docx|xlsx|txt|md)$') AND size <= 52428800 AS valid FROM {values('uploads')}""")
def upload_guard(spark, sf_dir):
    return spread(spark, sf_dir, "uploads").select("file_id", tx.safe_name(F.col("name")).alias("name"), metadata.valid_upload(F.col("name"), F.col("size")).alias("valid"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS plain, CAST(len(regexp_extract_all(lower(text), 'thst')) AS BIGINT) AS marks FROM documents")
def keyword_highlight(spark, sf_dir):
    marked = tx.highlight(F.col("text"), ["thst", "x"])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace(marked, "</?mark>", "")).alias("plain"), F.regexp_count(marked, F.lit("<mark>")).cast("bigint").alias("marks"))


# streams


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_ingest_dedup(spark, sf_dir):
    from ..streaming.ingest import distinct_stream

    return distinct_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema, ["user_id", "event_type"])


from . import extras, files, stored  # noqa: E402, F401  their queries join those above
