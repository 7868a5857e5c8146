"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or joins about, where adaptive execution would make tasks that grow with the table.
TASK_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without; it gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lakequill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/lakequill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which ends its lineage."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def dealt(df: DataFrame, *keys: str, rows: int = 10_000) -> DataFrame:
    """df in partitions of about so many rows, dealt by keys, so that a task's work doesn't grow with the table; as it is if it has no more.

    Small tables often lie in one block of one file, which one task would read, however many rows come of each row.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > 1 else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` has returned and that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that operators have left in the shared folder; no result that reads it may still be in use."""
    _delete(spark, f"{shared_dir(spark)}/lakequill")
