"""What a service calls: ingest, ask, fill, edit and convert, over tables below one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .models import Embedder, FirstSentence, HashingEmbedder, LanguageModel, embed, overlap_scorer, prompt
from .operators import conflicts, extras, instructions, predicates, retrieval, sheets, tables
from .session import cut
from .stores.postings import KeywordIndex
from .stores.snapshots import GRACE_SECONDS
from .stores.vectors import VectorIndex
from .streaming.ingest import ChunkStore


class Workspace:
    """Files with their chunks, a vector index and a keyword index of these, each with versions, below one folder.

    What is ingested is embedded and indexed once. A question embeds itself alone, and reads cells of vectors, postings of
    its terms and the texts of the candidates' files. The name and dimension of the embedder are facts of the index: with
    another one ``Changed`` is raised, and ``rebuild`` makes a new version of the index from the chunks, which stay.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, model: LanguageModel | None = None):
        self.spark, self.store = spark, ChunkStore(spark, folder)
        self.embedder, self.model = embedder or HashingEmbedder(), model or FirstSentence()
        facts = {"embedder": type(self.embedder).__name__, "size": len(self.embedder.encode(["dimension"])[0])}
        self.vectors, self.words = VectorIndex(spark, f"{folder}/vectors", facts), KeywordIndex(spark, f"{folder}/words")

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        rows = chunks.select(F.col("chunk_id").alias("id"), "file_id", F.lit(None).cast("string").alias("label"), "content")
        return embed(rows, "content", self.embedder).drop("content")

    @staticmethod
    def _texts(chunks: DataFrame) -> DataFrame:
        return chunks.select(F.col("chunk_id").alias("id"), "file_id", F.col("content").alias("text"))

    def rebuild(self) -> None:
        """Indexes all chunks anew, with the embedder at hand; versions of the indexes before stay readable."""
        rows = self.store.read()
        if rows is None:
            raise LookupError("nothing is ingested")
        self.vectors.build(self._embedded(rows))
        self.words.build(self._texts(rows))

    def ingest(self, files: DataFrame, force: bool = True) -> None:
        """Chunks, embeds and indexes files (file_id, text); without force those that are there already stay as they are."""
        if self.vectors.table.versions():
            self.vectors.rows()  # raises before anything is written if the embedder has changed
        ids = files.select(F.col("file_id").cast("bigint").alias("file_id"))
        known = self.store.read()
        if known is not None and not force:
            ids = cut(ids.join(known.select("file_id").distinct(), "file_id", "left_anti"), "new-files")
            files = files.join(ids, "file_id", "left_semi")
        self.store.merge(files)
        if known is None or not self.vectors.table.versions():
            self.rebuild()
            return
        rows = self.store.read().join(ids.distinct(), "file_id", "left_semi")
        self.vectors.upsert(self._embedded(rows), ids)
        self.words.upsert(self._texts(rows), ids)

    def delete(self, file_ids: Sequence[int]) -> None:
        ids = self.spark.createDataFrame([(i,) for i in file_ids], "file_id bigint")
        self.store.delete(ids)
        if self.vectors.table.versions():
            self.vectors.delete(ids)
            self.words.delete(ids)

    def vacuum(self, grace: float = GRACE_SECONDS) -> None:
        """Drops versions that were superseded long ago."""
        for t in (self.store.table, self.vectors.table, self.words.table):
            t.vacuum(grace=grace)

    def retrieve(self, question: str, file_ids: Sequence[int] | None = None, k: int = 8, exact: bool = False) -> DataFrame:
        """The k best chunks: both searches, fused, deduplicated, reranked and put in order by novelty.
        """
        if not self.store.table.versions():
            raise LookupError("nothing is ingested")
        where = F.col("file_id").isin(list(file_ids)) if file_ids else None  # statistics are those of these files
        terms = tx.query_terms(question)
        vector = [float(x) for x in self.embedder.encode([question])[0]]
        near = cut(self.vectors.search(vector, 2 * k, exact=exact, where=where), "near")
        best = cut(self.words.search(terms, 3 * k, where), "best")
        ids = near.select("id", "file_id").unionByName(best.select("id", "file_id")).distinct()
        scores = best.select("id", "score").unionByName(self.words.scores(terms, ids.join(best, "id", "left_anti"), where))
        cand = retrieval.merge_candidates(near.select(F.col("id").alias("chunk_id"), "distance"), scores.select(F.col("id").alias("chunk_id"), "score"), "chunk_id", 3 * k)
        lists = [cand.where("vector_score > 0 OR distance IS NOT NULL").select("chunk_id", F.col("vector_score").alias("score")), cand.where("bm25_score > 0").select("chunk_id", F.col("bm25_score").alias("score"))]
        fused = cand.select("chunk_id").join(retrieval.rrf(lists, "chunk_id"), "chunk_id", "left").na.fill(0.0, ["hybrid_score"])
        files = [r["file_id"] for r in ids.select("file_id").distinct().collect()]  # of some tens of candidates
        rows = self.store.read().where(F.col("file_id").isin(files))
        found = rows.select("chunk_id", "file_id", "content", "page").join(F.broadcast(fused), "chunk_id")
        kept = cut(retrieval.content_dedup(found, "content", [F.col("hybrid_score").desc(), F.col("chunk_id")]).orderBy(F.col("hybrid_score").desc(), "chunk_id").limit(2 * k), "kept")
        ranked = cut(retrieval.rerank(kept.orderBy(F.col("hybrid_score").desc(), "chunk_id"), "content", terms, k, overlap_scorer(terms)), "ranked")
        own = self.vectors.rows().where(F.col("file_id").isin(files)).join(F.broadcast(ranked.select(F.col("chunk_id").alias("id"))), "id", "left_semi")
        order = retrieval.mmr(own.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id", "embedding", vector)
        return ranked.join(order, "chunk_id").orderBy("place").drop("place")

    def ask(self, question: str, file_ids: Sequence[int] | None = None, k: int = 8) -> dict:
        found = self.retrieve(question, file_ids, k).toPandas()
        if not len(found):
            return {"query": question, "answer": "", "sources": [], "confidence": -1.0, "conflicts": []}
        answer = self.model.complete(prompt(question, found["content"].tolist()))
        mean, top = float(found["hybrid_score"].mean()), float(found["hybrid_score"].max())
        sure = round(max(0.15, min(0.95, 0.15 + min(1.0, max(mean, 0.9 * top) / 0.048) * 0.8)), 2)
        rows = self.spark.createDataFrame([(r.chunk_id, str(r.file_id), r.content) for r in found.itertuples()], "chunk_id string, source_file string, content string")
        seen = [r.asDict() for f in (conflicts.money, conflicts.dates, conflicts.ratios, conflicts.companies) for r in f(rows).collect()]
        return {"query": question, "answer": answer, "sources": found[["chunk_id", "file_id", "page", "content"]].to_dict("records"), "confidence": sure, "conflicts": seen}

    # tables

    def template_fields(self, text: str) -> list[str]:
        import re

        return list(dict.fromkeys(x.strip() for x in re.findall(r"\{\{([^{}]+)\}\}", text)))

    def fill(self, source: DataFrame, fields: Sequence[str], order: str, instruction: str = "", most: int | None = None) -> DataFrame:
        """Long cells of the template's fields from the rows that an instruction keeps."""
        if instruction:
            rules = predicates.parse_rules(instruction)
            kept = source.where(predicates.any_of(source, [rules])) if rules else predicates.include_exclude(source, instruction)
            source = source if kept is None else kept
        import re

        norm = lambda s: re.sub(r"[ _/\\]", "", s.lower())
        by_name = {norm(c): c for c in reversed(source.columns)}
        mapping = {f: by_name[norm(f)] for f in fields if norm(f) in by_name}
        return tables.fill_rows(source, order, mapping, most)

    # edits

    def operate(self, rows: DataFrame, text: str, sheet: str = "Sheet1", doc_id: int = 1) -> DataFrame:
        """The table, cells or paragraphs after a plain-language command; what isn't understood raises ValueError.

        Cells (sheet, row, col, value) are edited in one sheet; a paragraph is added to one document.
        """
        op = instructions.parse(text)
        p = op.parameters
        if {"sheet", "row", "col", "value"} <= set(rows.columns):
            return self._edit_cells(rows, op, sheet)
        if op.kind in ("delete_heading", "edit_heading") and "level" in rows.columns:
            return extras.edit_heading(rows, "doc_id", self._number(p.get("position", "第一个")), p.get("value", "") if op.kind == "edit_heading" else None)
        if op.kind == "add_paragraph" and "ordinal" in rows.columns:
            return sheets.insert_paragraph(rows, doc_id, self._number(p.get("position", "第一段")) - 1, p.get("value", ""))
        if op.kind == "extract_content" and "ordinal" in rows.columns:
            return self.extract(rows)
        if op.kind == "conditional_filter":
            return predicates.conditional_filter(rows, p["column"], p["condition"])
        if op.kind == "conditional_delete":
            return predicates.conditional_delete(rows, p["column"], p["condition"])
        if op.kind == "replace_text":
            return sheets.replace_text(rows, p["old"], p["new"])
        if op.kind in ("delete_paragraph", "edit_paragraph"):
            place = sheets.locate(rows, p.get("position", "")).select("doc_id", F.col("ordinal").alias("__at"))
            got = rows.join(F.broadcast(place), "doc_id", "left")  # a row for each document that has the paragraph
            if op.kind == "delete_paragraph":
                kept = got.where(F.col("__at").isNull() | (F.col("ordinal") != F.col("__at")))
                return kept.withColumn("ordinal", F.when(F.col("ordinal") > F.col("__at"), F.col("ordinal") - 1).otherwise(F.col("ordinal"))).drop("__at")
            return got.withColumn("text", F.when(F.col("ordinal") == F.col("__at"), F.lit(p.get("value", ""))).otherwise(F.col("text"))).drop("__at")
        raise ValueError(f"not understood: {text}")

    def _number(self, position: str) -> int:
        """The number in ``第三行``; 1 if there is none."""
        word = "".join(c for c in position if c in "0123456789一二两三四五六七八九十百")
        return self.spark.range(1).select(tx.chinese_number(F.lit(word)).alias("n")).first()["n"] or 1

    def _edit_cells(self, cells: DataFrame, op: instructions.Operation, sheet: str) -> DataFrame:
        p = op.parameters
        at = self._number(p.get("position", ""))
        if op.kind == "edit_cell" and "cell" in p:
            place = self.spark.range(1).select(tx.cell_row(F.lit(p["cell"])).alias("row"), tx.cell_column(F.lit(p["cell"])).alias("col"))
            return sheets.edit_cells(cells, place.select(F.lit(sheet).alias("sheet"), "row", "col", F.lit(p.get("value", "")).alias("value")))
        if op.kind in ("add_row", "add_column"):
            value = p.get("value", "")
            return sheets.insert_row(cells, sheet, at, value.split("，")) if op.kind == "add_row" else sheets.insert_column(cells, sheet, at, value)
        if op.kind in ("delete_row", "delete_column") and "position" in p:
            return (sheets.delete_row if op.kind == "delete_row" else sheets.delete_column)(cells, sheet, at)
        if op.kind == "conditional_format" and "condition" in p:
            return predicates.conditional_style(cells, p["condition"], p.get("color", "FFFF00"))
        raise ValueError(f"not understood: {op.instruction}")

    def summary(self, file_id: int) -> str:
        rows = self.store.read()
        first = rows.where(F.col("file_id") == file_id).orderBy("pos").limit(1).select(tx.summary(F.col("content")).alias("s")).first()
        return first["s"] if first else ""

    def files(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """A page of file ids with their chunks and characters."""
        rows = self.store.read()
        if rows is None:
            return self.spark.createDataFrame([], "file_id bigint, n_chunks bigint, n_chars bigint")
        return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content").cast("bigint")).alias("n_chars")).orderBy("file_id").offset(offset).limit(limit)

    def preview(self, rows: DataFrame, text: str, key: str, most: int = 50) -> DataFrame:
        """How many rows a conditional command touches, and the first of their keys, without doing it."""
        op = instructions.parse(text)
        if "condition" not in op.parameters:
            raise ValueError(f"not understood: {text}")
        return predicates.preview(rows, op.parameters["column"], op.parameters["condition"], key, most)

    def extract(self, paragraphs: DataFrame, kind: str = "all") -> DataFrame:
        """Paragraphs of a kind: body, heading, or all that aren't blank."""
        rows = sheets.numbered(paragraphs)
        return rows.where("kind != 'blank'") if kind == "all" else rows.where(F.col("kind") == kind)

    def split(self, rows: DataFrame, order: str, size: int, folder: str) -> None:
        """Writes parts of size rows, a folder for each."""
        tables.split_rows(rows, order, size).write.partitionBy("part").parquet(folder)

    def to_csv(self, rows: DataFrame, folder: str) -> None:
        rows.write.option("header", True).csv(folder)

    def markdown_of(self, path: str) -> DataFrame:
        """path and text of each docx file as markdown."""
        from .sources import office

        return office.docx_to_markdown(office.read_docx(self.spark, path))
