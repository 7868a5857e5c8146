"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, html, infill, langid, lm, matroska, mixing, neardup, pii, repeats, sharding, tokens
from .common import id_remainder, read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_all(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 5) == 0
    return langid.identify(docs, langid.train(docs, 5)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), 0.85)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_media(matroska.store_texts(read_table(spark, sf_dir, "documents")))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mix_sources, op2_lattice_likelihood, op3_token_files, op4_main_text, op5_language_id, op6_personal_data, op7_size_tiered_shards, op8_near_duplicates, op9_media_columns, op10_benchmark_leaks, op11_fill_in_middle, op12_vector_codes, op13_repeated_passages)}


#: Links and their closure, for small tables: all pairs that share a shingle are counted.
_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
 l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 pairs AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, pairs.y FROM reach JOIN pairs ON reach.r = pairs.x),
 c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
 SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN c USING (doc_id)"""


#: The article of pages as the tables have them, by a rule of their layout that the operator doesn't know.
_PAGE_SQL = r"""WITH parts AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS bs FROM pages),
 plain AS (SELECT page_id, url, list_filter(list_transform(bs, lambda b: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS bs FROM parts),
 t AS (SELECT page_id, url, coalesce(array_to_string(bs, chr(10) || chr(10)), '') AS text FROM plain)
 SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""


#: Units by their pattern, pieces by place, digests of what they make.
_INFILL_SQL = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT *, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(us) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(us) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS f FROM u),
 p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(us[1:least(a, b)], ''), '') AS p1, coalesce(array_to_string(us[least(a, b) + 1:greatest(a, b)], ''), '') AS p2, coalesce(array_to_string(us[greatest(a, b) + 1:], ''), '') AS p3 FROM d)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p1) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(p2) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p1 || '<S>' || p3 || '<M>' || p2 ELSE '<S>' || p3 || '<P>' || p1 || '<M>' || p2 END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Rounds one after another, each distance computed."""
    dist = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""ok AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * {scale}) AS BIGINT)) AS q, len(embedding) // {parts} AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, p, q[p * w + 1:p * w + w] AS v FROM ok, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(({dist} * {entries} + b.e)) AS m FROM x JOIN b{k} b USING (p) GROUP BY r, p)")
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(CAST(floor(s / CAST(c AS DOUBLE)) AS BIGINT) ORDER BY i) AS v FROM
 (SELECT p, e, i, sum(y) AS s, count(*) AS c FROM (SELECT p, m % {entries} AS e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{k} JOIN x USING (r, p)) GROUP BY ALL) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""
            )
    last = rounds
    return (
        "WITH " + ",\n ".join(steps) + f""",
 f AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{last} GROUP BY r),
 k AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM b{last}))
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, k.s AS codebooks_sha256 FROM ok JOIN f USING (r) CROSS JOIN k"""
    )


#: Every window of 20 words with its first place; for small tables.
_REPEATS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM g),
 c AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM f, range(20) r(j) WHERE k > 1 GROUP BY doc_id)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))), lambda i: ws[i]) END, ' ')) AS kept_sha256 FROM w LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": _INFILL_SQL, "op12_vector_codes": _codes_sql(), "op13_repeated_passages": _REPEATS_SQL, "op4_main_text": _PAGE_SQL, "op8_near_duplicates": _NEAR_SQL}
