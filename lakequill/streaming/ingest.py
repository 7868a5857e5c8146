"""Incremental ingestion: files that arrive become chunks, once each, and replace what an earlier version left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking
from ..session import fresh_dir
from ..stores.snapshots import SnapshotTable, State


def distinct_stream(spark: SparkSession, folder: str, glob: str, schema, keys: list[str]) -> DataFrame:
    """Reads files of a folder as a stream, keeps the first row of each key, and returns the sink's table.

    The trigger takes all that is there and ends; a later call with the same checkpoint goes on from there.
    """
    base = fresh_dir(spark, "stream")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).select(*keys).dropDuplicates(keys)
    query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def distinct_with_watermark(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Bounded state: equal keys within the delay count once (an extension)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class ChunkStore:
    """The chunks of files below a folder, with versions; each batch replaces its files' chunks and costs its own rows."""

    SCHEMA = "file_id bigint, pos bigint, chunk_id string, content string, header string, page bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.table = SnapshotTable(spark, f"{folder}/chunks", self.SCHEMA, "file_id", order=("file_id",))

    def chunk(self, files: DataFrame) -> DataFrame:
        return chunking.chunks(files.select(F.col("file_id").cast("bigint").alias("file_id"), "text"), "file_id", tx.sections(tx.mark_headers(tx.clean(F.col("text")))))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The chunks of a version, the latest by default; None before the first one."""
        return self.table.read(version) if self.table.versions() else None

    def merge(self, files: DataFrame, force: bool = True) -> State:
        """Adds the chunks of files (file_id, text); without force, files that are there already stay as they are."""
        old = self.read()
        if old is not None and not force:
            files = files.join(old.select("file_id").distinct(), "file_id", "left_anti")
        return self.table.upsert(self.chunk(files), files.select(F.col("file_id").cast("bigint").alias("file_id")))

    def delete(self, ids: DataFrame) -> State:
        """Removes files by id."""
        return self.table.delete(ids)

    def ingest(self, stream: DataFrame) -> None:
        """Runs a stream of (file_id, text) to its present end, batch by batch; a batch that is run again replaces itself."""
        query = stream.writeStream.foreachBatch(lambda df, _: self.merge(df.dropDuplicates(["file_id"]))).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
