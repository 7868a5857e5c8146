"""A stored vector index: rows in cells around centroids, of which a search reads a few, or all that can matter.

Centroids come from k-means over a sample of SAMPLE_ROWS rows a cell, drawn by hash; every row is indexed. A cell is a folder, so a search prunes cells as
partitions. The distance from a row to its centroid is stored, and a cell's radius is the largest one. By the triangle
inequality no row of a cell is nearer to the query than the query's distance to the centroid less the radius. An exact
search reads the nearest cells first and then all whose bound doesn't exceed the k-th distance found; an approximate one
stops after the first step.

Centroids are at most MOST_CELLS vectors and are sent to all tasks. Rows of null vectors, or of another dimension than
the index has, aren't searchable and are refused when they are added.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, discard
from .snapshots import Changed, SnapshotTable, State

MOST_CELLS = 4096
#: Rows a cell has on average, and rows of the sample for each cell.
CELL_ROWS, SAMPLE_ROWS = 1000, 64
ROUNDS = 8
PROBES = 8
#: What sums of rounded squares may be off, relative to the distance.
SLACK = 1e-6


def cell_count(n: int) -> int:
    return int(max(1, min(MOST_CELLS, n // CELL_ROWS, max(1, n // 8)))) if n >= CELL_ROWS else int(max(1, n**0.5 // 2))


def _cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return np.argmin((centres * centres).sum(1)[None] - 2 * (x @ centres.T), 1) if len(x) else np.zeros(0, int)


def kmeans(rows: DataFrame, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a table of vectors (v, h) after some rounds; the start is the k rows of the lowest h.

    A round is a scan, from which each task sends a sum for each cell; cells that get empty keep their place.
    """
    start = rows.orderBy("h").limit(k).collect()
    c = np.array([r["v"] for r in start], float).reshape(len(start), -1)

    for _ in range(rounds if len(c) > 1 else 0):
        centres = c

        def sums(batches, centres=centres):
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
                of = _cells(x, centres)
                np.add.at(total, of, x)
                n += np.bincount(of, minlength=len(centres))
            used = np.flatnonzero(n)
            yield pd.DataFrame({"cell": used.astype(np.int32), "n": n[used], "total": list(total[used])})

        def add(pdf):
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "n": [pdf["n"].sum()], "total": [np.sum(pdf["total"].tolist(), 0)]})

        kind = "cell int, n bigint, total array<double>"
        for r in rows.select("v").mapInPandas(sums, kind).groupBy("cell").applyInPandas(add, kind).collect():  # a row for each cell
            c = c.copy() if c is centres else c
            c[r["cell"]] = np.array(r["total"]) / r["n"]
    return c


class VectorIndex:
    """Vectors of keyed rows that belong to files; an upsert replaces all rows of the files it has."""

    def __init__(self, spark: SparkSession, folder: str, facts: dict | None = None, id_type: str = "string"):
        self.spark, self.folder = spark, folder.rstrip("/")
        schema = f"id {id_type}, file_id bigint, label string, embedding array<double>, far double, cell int"
        self.table = SnapshotTable(spark, f"{self.folder}/rows", schema, "file_id", ("cell",), facts)

    # centroids belong to the version of the table that was made with them

    def _centroids(self, name: str) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centroids/{name}").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["centre"] for r in rows], float)

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """Rows with their cell and the distance to its centroid."""

        def place(batches):
            for pdf in batches:
                x = np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1)
                if len(x) and x.shape[1] != centres.shape[1]:
                    raise Changed(f"vectors have {x.shape[1]} dimensions, the index {centres.shape[1]}")
                of = _cells(x, centres)
                yield pd.DataFrame({"id": pdf["id"], "file_id": pdf["file_id"], "label": pdf["label"], "embedding": pdf["embedding"], "far": np.sqrt(((x - centres[of]) ** 2).sum(1)) if len(x) else [], "cell": of.astype(np.int32)})

        return rows.select(F.col("id").cast(self.table.schema["id"].dataType).alias("id"), F.col("file_id").cast("bigint").alias("file_id"), F.col("label").cast("string").alias("label"), tx.doubles(F.col("embedding")).alias("embedding")).mapInPandas(place, self.table.schema)

    def build(self, rows: DataFrame, cells: int | None = None) -> State:
        """An index of these rows (id, file_id, label, embedding) in place of what is there; older versions stay readable."""
        good = rows.where(F.col("embedding").isNotNull())
        n = good.count()
        k = cells or cell_count(n)
        share = min(1.0, k * SAMPLE_ROWS / max(n, 1))
        hashed = good.select(tx.doubles(F.col("embedding")).alias("v"), F.xxhash64("id").alias("h"))
        sample = cut(hashed.where(F.pmod("h", F.lit(1 << 20)) <= share * (1 << 20)), "vector-sample")
        centres = kmeans(sample, k)
        discard(sample)
        if not len(centres):
            centres = np.zeros((1, 0))
        name = uuid.uuid4().hex
        kept = self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        kept.coalesce(1).write.parquet(f"{self.folder}/centroids/{name}")
        dim = centres.shape[1]
        self.table.facts = {**self.table.facts, "dimension": dim, "centroids": name}
        return self.table.replace_all(self._placed(good, centres))

    def _open(self, version: int | None = None) -> tuple[State, np.ndarray]:
        """The state of a version and its centroids, checked against the facts that the caller has given."""
        state = self.table.state(version)
        own = {k: v for k, v in self.table.facts.items() if k not in ("dimension", "centroids")}
        off = {k: (state.facts.get(k), v) for k, v in own.items() if state.facts.get(k) != v}
        if not state.version or off:
            raise Changed(f"stored facts differ: {off}" if off else "no index is built")
        self.table.facts = state.facts
        return state, self._centroids(state.facts["centroids"])

    def upsert(self, rows: DataFrame, files: DataFrame | None = None) -> State:
        """Adds rows in place of all rows of their files, or of the files that are named."""
        _, centres = self._open()
        return self.table.upsert(self._placed(rows.where(F.col("embedding").isNotNull()), centres), files)

    def delete(self, files: DataFrame) -> State:
        self._open()
        return self.table.delete(files)

    def rows(self, version: int | None = None) -> DataFrame:
        self._open(version)
        return self.table.read(version)

    def search(self, query: Sequence[float], k: int = 16, probes: int = PROBES, exact: bool = False, where=None, version: int | None = None) -> DataFrame:
        """id, file_id, distance (squared) and cell of the k nearest rows, ties by id; of all rows if exact, else of the nearest cells.

        ``where`` is a condition on rows (file_id, label), so bounds and results are those of the rows that meet it.
        """
        rows, near, rest, first = self._planned(query, k, probes, exact, where, version)
        if not rest:
            return first
        others = rows.where(F.col("cell").isin(rest))
        return first.unionByName(others).orderBy("distance", "id").limit(k)

    def _planned(self, query, k, probes, exact, where=None, version=None) -> tuple[DataFrame, list[int], list[int], DataFrame]:
        """Rows with their distances, the nearest cells, the others that an exact search has to read, and the best rows of the former."""
        _, centres = self._open(version)
        q = np.asarray(query, float)
        if len(q) != centres.shape[1]:
            raise Changed(f"the query has {len(q)} dimensions, the index {centres.shape[1]}")
        rows = self.table.read(version)
        rows = rows if where is None else rows.where(where)
        distance = tx.squared_distance(F.col("embedding"), F.array(*[F.lit(float(v)) for v in q]))
        found = rows.select("id", "file_id", distance.alias("distance"), "cell")
        to = np.sqrt(((centres - q) ** 2).sum(1))
        near = np.argsort(to, kind="stable")[:probes].tolist()
        first = found.where(F.col("cell").isin(near)).orderBy("distance", "id").limit(k)
        if not exact:
            return found, near, [], first
        got = first.collect()  # k rows
        radius = {r["cell"]: r["r"] for r in rows.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # MOST_CELLS at most
        rest = [c for c in radius if c not in set(near)]
        if len(got) == k:
            worst = got[-1]["distance"] ** 0.5
            rest = [c for c in rest if to[c] - radius[c] <= worst + SLACK * (worst + to[c])]
        return found, near, rest, self.spark.createDataFrame(got, first.schema)

    def cells_read(self, query: Sequence[float], k: int = 16, probes: int = PROBES) -> tuple[int, int]:
        """How many cells an exact search reads, and how many there are."""
        _, near, rest, _ = self._planned(query, k, probes, True)
        return len(near) + len(rest), len(self._open()[1])
