"""Files, tasks and outputs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_uploads(files: DataFrame, digest: Column, key: str) -> DataFrame:
    """The first file of each content."""
    w = Window.partitionBy("__d").orderBy(key)
    return files.withColumn("__d", digest).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__d", "__rn")


def page(files: DataFrame, key: str, offset: int, limit: int, where: Column | None = None) -> DataFrame:
    got = files if where is None else files.where(where)
    return got.orderBy(key).offset(offset).limit(limit)


def status_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "indexed").cast("bigint")).alias("indexed"), F.sum("file_size").alias("bytes"))


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("pending", "processing"))


def cascade(files: DataFrame, tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.join(gone, "file_id", "left_anti"), tasks.join(gone, "file_id", "left_anti")


def to_index(files: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Files that an incremental run indexes."""
    return files if force else files.join(indexed.select("file_id"), "file_id", "left_anti")


def valid_upload(name: Column, size: Column, most_bytes: int = 50 * 2**20) -> Column:
    from ..functions.text import extension

    return extension(name).isin("pdf", "docx", "xlsx", "txt", "md") & (size <= most_bytes)


def guard(wanted: DataFrame, files: DataFrame, status: str = "indexed") -> DataFrame:
    """What stands against a request for files: file_id and outcome ('ok', 'missing', or 'not ' and the status it needs).

    files are (file_id, status); of an id that comes several times, one row of that status is enough.
    """
    known = files.groupBy("file_id").agg(F.max((F.col("status") == status).cast("int")).alias("__ok"))
    outcome = F.when(F.col("__ok") == 1, "ok").when(F.col("__ok") == 0, f"not {status}").otherwise("missing")
    return wanted.select("file_id").distinct().join(known, "file_id", "left").select("file_id", outcome.alias("outcome"))


def require(wanted: DataFrame, files: DataFrame, status: str = "indexed") -> None:
    """Raises LookupError for the first file that isn't there, and ValueError for one that isn't ready."""
    bad = guard(wanted, files, status).where("outcome != 'ok'").orderBy(F.col("outcome") != "missing", "file_id").first()
    if bad is not None:
        raise (LookupError if bad["outcome"] == "missing" else ValueError)(f"file {bad['file_id']} is {bad['outcome']}")
