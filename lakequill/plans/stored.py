"""Queries over stored indexes and versioned tables; loaded with the catalogue.

An index is built once a session for a table and read by all queries that need it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_dir
from ..stores.postings import KeywordIndex
from ..stores.snapshots import SnapshotTable
from ..stores.vectors import VectorIndex
from .catalog import _DIST, _Q, _WORDS, DIRECTION, TERMS, _bm25_sql, query, table

_BUILT: dict[tuple, object] = {}


def _once(spark, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _vector_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(10)).alias("file_id"), F.col("label").cast("string").alias("label"), "embedding")


def _vectors(spark, sf_dir) -> VectorIndex:
    """All embeddings (version 1), then file 3 with its vectors turned round, and without file 5."""

    def make():
        index = VectorIndex(spark, fresh_dir(spark, "vector-index"), id_type="bigint")
        index.build(_vector_rows(spark, sf_dir))
        turned = _vector_rows(spark, sf_dir).where("file_id = 3").withColumn("embedding", F.transform("embedding", lambda x: -x.cast("double")))
        index.upsert(turned)
        index.delete(spark.createDataFrame([(5,)], "file_id bigint"))
        return index

    return _once(spark, sf_dir, "vectors", make)


def _found(rows):
    return rows.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 16")
def vector_index_topk(spark, sf_dir):
    """The exact search of an index as it was built."""
    return _found(_vectors(spark, sf_dir).search(DIRECTION, 16, exact=True, version=1))


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings WHERE label IN (1, 3) ORDER BY {_DIST}, vec_id LIMIT 8")
def vector_index_filtered(spark, sf_dir):
    return _found(_vectors(spark, sf_dir).search(DIRECTION, 8, exact=True, where=F.col("label").isin("1", "3"), version=1))


_TURNED = "(SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -CAST(x AS DOUBLE)) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS embedding FROM embeddings WHERE vec_id % 10 <> 5)"


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM {_TURNED} ORDER BY {_DIST}, vec_id LIMIT 40")
def vector_index_upsert(spark, sf_dir):
    """The exact search after a file was replaced and another one deleted."""
    return _found(_vectors(spark, sf_dir).search(DIRECTION, 40, exact=True))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(7)).alias("file_id"), "text")


def _words(spark, sf_dir) -> KeywordIndex:
    """All documents (version 1), then file 2 with its texts in reverse order of lines, and without file 4."""

    def make():
        index = KeywordIndex(spark, fresh_dir(spark, "keyword-index"), id_type="bigint")
        index.build(_docs(spark, sf_dir))
        index.upsert(_docs(spark, sf_dir).where("file_id = 2").withColumn("text", F.concat_ws(" ", F.lit("thst ined"), F.substring("text", 1, 300))))
        index.delete(spark.createDataFrame([(4,)], "file_id bigint"))
        return index

    return _once(spark, sf_dir, "words", make)


def _scored(rows):
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql() + " SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 10")
def keyword_index_topk(spark, sf_dir):
    """The k best documents by postings of the terms alone, in blocks whose bound is high enough."""
    return _scored(_words(spark, sf_dir).search(TERMS, 10, version=1))


@query(_bm25_sql("WHERE doc_id % 7 IN (1, 3)") + " SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 10")
def keyword_index_scoped(spark, sf_dir):
    """Within some files: statistics are those of these files."""
    return _scored(_words(spark, sf_dir).search(TERMS, 10, F.col("file_id").isin(1, 3), version=1))


_EDITED = "(SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 7 = 2 THEN 'thst ined ' || left(text, 300) ELSE text END), '[\\p{L}\\p{N}_]{2,}') AS toks FROM documents WHERE doc_id % 7 <> 4)"


@query(_bm25_sql().replace(_WORDS, _EDITED) + " SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 25")
def keyword_index_upsert(spark, sf_dir):
    """After a file was replaced and another one deleted."""
    return _scored(_words(spark, sf_dir).search(TERMS, 25))


@query(f"SELECT tok AS term, CAST(count(*) AS BIGINT) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM {_EDITED}) WHERE tok IN ({_Q}) GROUP BY tok")
def keyword_index_frequencies(spark, sf_dir):
    return _words(spark, sf_dir).rows("posting", TERMS).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _orders(spark, sf_dir) -> SnapshotTable:
    """Version 1 has all orders; 2 twice the price of every tenth customer's; 3 lacks every tenth customer; 4 is merged."""

    def make():
        rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
        kept = SnapshotTable(spark, fresh_dir(spark, "orders"), rows.schema, "o_custkey", ("o_orderstatus",), order=("o_custkey",))
        kept.upsert(rows)
        kept.upsert(rows.where("o_custkey % 10 = 3").withColumn("o_totalprice", F.col("o_totalprice") * 2))
        kept.delete(rows.where("o_custkey % 10 = 5").select("o_custkey"))
        kept.merge(whole=True)
        return kept

    return _once(spark, sf_dir, "orders", make)


@query(
    """WITH v AS (SELECT * FROM range(1, 5) t(version)), o AS (SELECT version, o_orderstatus, CASE WHEN version > 1 AND o_custkey % 10 = 3 THEN 2 ELSE 1 END * o_totalprice AS p FROM orders, v WHERE version < 3 OR o_custkey % 10 <> 5)
 SELECT CAST(version AS INTEGER) AS version, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(p), 2) AS total FROM o GROUP BY version, o_orderstatus"""
)
def table_versions(spark, sf_dir):
    """Each version of a table that was written, replaced in part, deleted from and merged."""
    kept, out = _orders(spark, sf_dir), None
    for version in range(1, 5):
        rows = kept.read(version).withColumn("version", F.lit(version))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("version", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# conditions and changes as rows


def _rules(spark, sf_dir):
    """Rules of a table for each customer: orders of its own above its balance, or urgent ones of a range of customers."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("tbl"), "c_acctbal")
    text = lambda c: c.cast("string")
    rule = lambda grp, col, op, v1, v2="": F.struct(F.lit(grp).alias("grp"), F.lit(col).alias("col"), F.lit(op).alias("op"), text(v1).alias("v1"), F.lit(v2).alias("v2") if isinstance(v2, str) else text(v2).alias("v2"))
    own = F.array(rule(1, "o_custkey", "eq", F.col("tbl")), rule(1, "o_totalprice", "gte", F.floor(F.col("c_acctbal") * 20)))
    urgent = F.array(rule(2, "o_orderpriority", "eq", F.lit("1-URGENT")), rule(2, "o_custkey", "between", F.col("tbl"), F.col("tbl") + 3), rule(2, "orderstatus", "neq", F.lit("P")))
    rows = who.select("tbl", F.explode(F.when(F.col("tbl") % 50 == 0, F.concat(own, urgent)).otherwise(own)).alias("r"))
    return rows.select("tbl", "r.*")


_KEPT = """kept AS (SELECT c_custkey AS tbl, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= floor(c_acctbal * 20)
 UNION SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey % 50 = 0 AND o_orderpriority = '1-URGENT' AND o_custkey BETWEEN c_custkey AND c_custkey + 3 AND o_orderstatus <> 'P')"""


@query(f"WITH {_KEPT} SELECT CAST(tbl AS BIGINT) AS tbl, o_orderkey FROM kept")
def rules_of_tables(spark, sf_dir):
    from ..operators import rules

    return rules.matches(table(spark, sf_dir, "orders"), "o_orderkey", _rules(spark, sf_dir))


@query(
    f"""WITH {_KEPT}, c AS (SELECT o_orderkey, unnest([1, 2]) AS col, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus]) AS value FROM orders),
 own AS (SELECT tbl, col, value, row_number() OVER (PARTITION BY tbl, col ORDER BY o_orderkey) AS place FROM kept JOIN c USING (o_orderkey)),
 head AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY o_orderkey) AS place FROM c), none AS (SELECT c_custkey AS tbl FROM customer WHERE c_custkey NOT IN (SELECT tbl FROM kept))
 SELECT CAST(tbl AS BIGINT) AS tbl, CAST(col AS BIGINT) AS col, CAST(place AS BIGINT) AS place, value FROM own WHERE place <= 5 UNION ALL SELECT CAST(tbl AS BIGINT), CAST(col AS BIGINT), CAST(place AS BIGINT), value FROM none CROSS JOIN head WHERE place <= 5"""
)
def fill_many_tables(spark, sf_dir):
    """A template for each customer, filled from the orders that its own rules keep, all in one plan."""
    from ..operators import rules

    heads = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("tbl"), F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("col"), F.lit(h).alias("header")) for k, h in ((1, "O OrderKey"), (2, "o_orderstatus"), (3, "none such"))])).alias("h")).select("tbl", "h.*")
    return rules.fill_tables(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey", _rules(spark, sf_dir), heads, 5)


def _changes(spark, sf_dir):
    """A preview of open orders becoming urgent and customers of 7 becoming closed; meanwhile every fifth order has changed."""
    from ..operators import changes

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    wish = rows.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "1-URGENT").otherwise(F.col("o_orderpriority"))).withColumn("o_orderstatus", F.when(F.col("o_custkey") % 7 == 0, None).otherwise(F.col("o_orderstatus")))
    seen = changes.preview(rows, wish, "o_orderkey")
    now = rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "2-HIGH").otherwise(F.col("o_orderpriority"))).where("o_orderkey % 11 <> 0")
    return now, seen


_CHANGED = """r AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, CASE WHEN o_orderstatus = 'O' THEN '1-URGENT' ELSE o_orderpriority END AS p2, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 5 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS p1 FROM orders)"""


@query(f"WITH {_CHANGED} SELECT o_orderkey, s2 AS o_orderstatus, CASE WHEN p1 = p THEN p2 ELSE p1 END AS o_orderpriority FROM r WHERE o_orderkey % 11 <> 0")
def change_set_applied(spark, sf_dir):
    """The table after the changes, applied twice."""
    from ..operators import changes

    now, seen = _changes(spark, sf_dir)
    return changes.apply(changes.apply(now, seen, "o_orderkey"), seen, "o_orderkey").drop("o_custkey")


@query(
    f"""WITH {_CHANGED}, e AS (SELECT o_orderkey, 'o_orderpriority' AS field, p AS old, p2 AS new, p1 AS now FROM r WHERE p IS DISTINCT FROM p2 UNION ALL SELECT o_orderkey, 'o_orderstatus', s, s2, s FROM r WHERE s IS DISTINCT FROM s2)
 SELECT o_orderkey, field, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN now IS NOT DISTINCT FROM old THEN 'applied' WHEN now IS NOT DISTINCT FROM new THEN 'done' ELSE 'stale' END AS outcome FROM e"""
)
def change_set_outcome(spark, sf_dir):
    from ..operators import changes

    now, seen = _changes(spark, sf_dir)
    return changes.outcome(now, seen, "o_orderkey").select("o_orderkey", "field", "outcome")
