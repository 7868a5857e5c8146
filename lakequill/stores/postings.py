"""A stored keyword index: postings by term, with bounds for blocks of documents, so that a search reads its terms alone.

Postings are laid out in folders by a hash of the term; a search prunes folders, and row groups by term, since rows are
sorted. Documents are dealt into blocks by hash, the same for all terms. For each term and block the largest count and the
shortest document are kept in a small table of heads. A score grows with the count and falls with the length, so these give
an upper bound of what a document of the block can score for a query. A search for the best k first scores the blocks of
the highest bounds, and then those whose bound isn't below the k-th score found; the result is that of scoring everything.

Postings know their file. A search within some files takes its statistics from these files, as a search over an index of
them alone would. Files are replaced as a whole; bounds of replaced rows may linger until a merge, which costs time, no rows.

Results for odd input: null and blank texts have no terms and count as documents; terms are lower-cased; a query without
terms scores everything 0; documents that score 0 fill up the k rows by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.retrieval import B, K1
from ..session import cut
from .snapshots import Changed, SnapshotTable, State

#: Folders of terms; documents that a block has about.
FOLDERS, BLOCK_DOCS = 64, 256
#: Blocks that are scored first.
FIRST_BLOCKS = 32


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of a text with its count. A text's terms are in its row, so they need no shuffle to be counted."""
    for batch in batches:
        toks = batch.column("toks")
        row = np.repeat(np.arange(len(batch)), toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = toks.flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
        place = pa.array(pair // n)
        columns = [batch.column(c).take(place) for c in ("id", "file_id", "block", "dl")]
        yield pa.RecordBatch.from_arrays([*columns, coded.dictionary.take(pa.array(pair % n)), pa.array(tf, pa.int32())], ["id", "file_id", "block", "dl", "term", "tf"])


class KeywordIndex:
    """Texts that belong to files; an upsert replaces all texts of the files it has. All kinds of rows are one table, so
    one commit covers them."""

    def __init__(self, spark: SparkSession, folder: str, facts: dict | None = None, id_type: str = "string"):
        self.spark = spark
        schema = f"term string, block int, id {id_type}, file_id bigint, tf int, dl int, n bigint, kind string, folder int"
        self.table = SnapshotTable(spark, folder, schema, "file_id", ("kind", "folder"), facts, ("term", "id"))

    def _rows(self, docs: DataFrame, blocks: int, folders: int) -> DataFrame:
        kind = self.table.schema["id"].dataType
        own = docs.select(F.col("id").cast(kind).alias("id"), F.col("file_id").cast("bigint").alias("file_id"), tx.tokens(F.lower(F.coalesce(F.col("text"), F.lit("")))).alias("toks"))
        own = own.select("id", "file_id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("toks").alias("dl"), "toks")
        terms = own.mapInArrow(_counted, own.select("id", "file_id", "block", "dl", F.lit("").alias("term"), F.lit(0).alias("tf")).schema)
        folder = F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int").alias("folder")
        none = lambda kind: F.lit(None).cast(kind)
        postings = terms.select("term", "block", "id", "file_id", "tf", "dl", none("bigint").alias("n"), F.lit("posting").alias("kind"), folder)
        # heads belong to no file: they stay as bounds when one of their rows is replaced
        heads = terms.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count(F.lit(1)).alias("n"))
        heads = heads.select("term", "block", none(kind).alias("id"), none("bigint").alias("file_id"), "tf", "dl", "n", F.lit("head").alias("kind"), folder)
        lengths = own.select(none("string").alias("term"), "block", "id", "file_id", none("int").alias("tf"), "dl", none("bigint").alias("n"), F.lit("length").alias("kind"), F.lit(0).alias("folder"))
        return postings.unionByName(heads).unionByName(lengths)

    def build(self, docs: DataFrame, folders: int = FOLDERS) -> State:
        """An index of these texts (id, file_id, text) in place of what is there; older versions stay readable."""
        blocks = max(1, docs.count() // BLOCK_DOCS)
        self.table.facts = {**self.table.facts, "blocks": blocks, "folders": folders}
        return self.table.replace_all(self._rows(docs, blocks, folders))

    def _open(self, version: int | None = None) -> State:
        state = self.table.state(version)
        own = {k: v for k, v in self.table.facts.items() if k not in ("blocks", "folders")}
        off = {k: (state.facts.get(k), v) for k, v in own.items() if state.facts.get(k) != v}
        if not state.version or off:
            raise Changed(f"stored facts differ: {off}" if off else "no index is built")
        self.table.facts = state.facts
        return state

    def upsert(self, docs: DataFrame, files: DataFrame | None = None) -> State:
        """Adds texts in place of all texts of their files, or of the files that are named."""
        facts = self._open().facts
        return self.table.upsert(self._rows(docs, facts["blocks"], facts["folders"]), docs.select(F.col("file_id").cast("bigint").alias("file_id")) if files is None else files)

    def delete(self, files: DataFrame) -> State:
        self._open()
        return self.table.delete(files)

    def rows(self, kind: str, terms: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a kind (posting, head, length), of some terms alone if named; other folders aren't read."""
        facts = self._open(version).facts
        rows = self.table.read(version).where(F.col("kind") == kind)
        if terms is None:
            return rows
        wanted = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(facts["folders"])).cast("int") for t in terms]).first() if terms else ()
        return rows.where(F.col("folder").isin(sorted(set(wanted))) & F.col("term").isin(list(terms)))

    def statistics(self, where: Column | None = None, version: int | None = None) -> tuple[int, float]:
        """Texts and their mean length, of those that meet a condition on file_id."""
        rows = self.rows("length", version=version)
        r = (rows if where is None else rows.where(where)).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        return r["n"], r["avgdl"] or 0.0

    def weights(self, terms: Sequence[str], n: int, where: Column | None = None, version: int | None = None) -> dict[str, float]:
        """The weight of each term that occurs: the logarithm of its rarity, 0 for those that most texts have."""
        import math

        if where is None and not self._open(version).gone:
            rows = self.rows("head", terms, version).groupBy("term").agg(F.sum("n").alias("df"))
        else:
            rows = self.rows("posting", terms, version)
            rows = (rows if where is None else rows.where(where)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return {r["term"]: math.log(max(1.0, (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in rows.collect()}  # a row for each term of the query

    def search(self, terms: Sequence[str], k: int = 10, where: Column | None = None, version: int | None = None) -> DataFrame:
        """id, file_id, score of the k best texts, ties by id; ``where`` is a condition on file_id."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        n, avgdl = self.statistics(where, version)
        weight = {t: w for t, w in self.weights(terms, n, where, version).items() if w > 0}
        lengths = self.rows("length", version=version)
        lengths = (lengths if where is None else lengths.where(where)).select("id", "file_id", F.lit(0.0).alias("score")).orderBy("id").limit(k)
        if not weight or not n:
            return lengths
        part = self._part(weight, avgdl)
        heads = self.rows("head", list(weight), version).groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        bounds = cut(heads.groupBy("block").agg(F.sum(part).alias("bound")), "block-bounds")
        postings = self.rows("posting", list(weight), version)
        postings = postings if where is None else postings.where(where)

        def scored(rows: DataFrame) -> DataFrame:
            return rows.groupBy("id", "file_id").agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)

        first = [r["block"] for r in bounds.orderBy(F.col("bound").desc()).limit(FIRST_BLOCKS).collect()]
        got = scored(postings.where(F.col("block").isin(first))).collect()  # k rows
        least = got[-1]["score"] if len(got) == k else 0.0
        # a bound is a sum of rounded numbers, as scores are
        near = bounds.where(F.col("bound") >= least * (1 - 1e-9)).select("block")
        best = scored(postings.join(near, "block", "left_semi"))
        return best.unionByName(lengths.join(best.select("id"), "id", "left_anti")).orderBy(F.col("score").desc(), "id").limit(k)

    def scores(self, terms: Sequence[str], ids: DataFrame, where: Column | None = None, version: int | None = None) -> DataFrame:
        """id and score of the named texts (id, a few) that have a term; statistics are those of a search."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        n, avgdl = self.statistics(where, version)
        weight = {t: w for t, w in self.weights(terms, n, where, version).items() if w > 0}
        if not weight:
            return ids.select("id", F.lit(0.0).alias("score"))
        postings = self.rows("posting", list(weight), version).join(F.broadcast(ids.select("id")), "id", "left_semi")
        return (postings if where is None else postings.where(where)).groupBy("id").agg(F.sum(self._part(weight, avgdl)).alias("score"))

    @staticmethod
    def _part(weight: dict[str, float], avgdl: float) -> Column:
        """What a term adds to a score."""
        idf = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])[F.col("term")]
        return idf * F.col("tf") / (K1 * (1 - B + B * F.col("dl") / avgdl) + F.col("tf"))

    def blocks_read(self, terms: Sequence[str], k: int = 10) -> tuple[int, int]:
        """How many blocks a search scores in full, and how many hold one of its terms."""
        n, avgdl = self.statistics()
        weight = {t: w for t, w in self.weights(terms, n).items() if w > 0}
        part = self._part(weight, avgdl)
        heads = self.rows("head", list(weight)).groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        bounds = heads.groupBy("block").agg(F.sum(part).alias("bound"))
        best = self.search(terms, k).collect()
        return bounds.where(F.col("bound") >= best[-1]["score"] * (1 - 1e-9)).count(), bounds.count()
