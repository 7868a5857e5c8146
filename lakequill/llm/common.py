"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, fresh_dir, shared_dir  # noqa: F401

#: White space that parts words in every contract of this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


#: What goes to Python at once, at most; both sides hold several batches.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once by rows and by bytes.

    These are options of the session, read when a result is computed. All operators set the same values and never raise
    one that is lower, so it doesn't matter which ran last.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def gathered(batches, most: int, column: str = "text"):
    """Record batches put together until one has about so many bytes of text, for steps that gain from large portions."""
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it (file, hdfs, s3, gs)."""
    if "://" in uri or uri.startswith("file:/"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(n)


def ranked(df: DataFrame, order: list[str], rank: str, add: str | None = None, before: str | None = None) -> DataFrame:
    """df with its 0-based rank in the given order and, if asked, the sum of column ``add`` over all earlier rows.

    Rows are range-partitioned, each partition is numbered by itself, and the partitions' totals (one row each) give
    the offsets, so that no task gets the whole table.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    part = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    per = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), (F.sum(add) if add else F.lit(0)).cast("long").alias("s"))
    rows, n, s = [], 0, 0
    for r in sorted(per.collect(), key=lambda x: x["_part"]):  # one row for each partition
        rows.append((r["_part"], n, s))
        n, s = n + r["n"], s + (r["s"] or 0)
    offsets = spark.createDataFrame(rows, "_part int, _n long, _s long")
    w = Window.partitionBy("_part").orderBy(*order)
    out = part.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_n") + F.row_number().over(w) - 1)
    if add:
        earlier = F.coalesce(F.sum(add).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(before, F.col("_s") + earlier)
    return out.drop("_part", "_n", "_s")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}


def arrow_schema(ddl: str) -> tuple[str, pa.Schema]:
    """A schema string for mapInArrow and the Arrow schema of the same columns."""
    return ddl, pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of columns given as lists, numpy or Arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def release() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def portions(batches, most: int, column: str = "text"):
    """Record batches cut into ones of about so many bytes of text, which bounds a task's memory."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        release()
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
    release()


#: Least and most bits of a bitmap of keys: 512 KiB and 16 MiB.
BITS, MOST_BITS = 1 << 22, 1 << 27


def row_key(*columns: str) -> Column:
    """A hash that rows of equal columns share."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def key_bitmap(keys: DataFrame, column: str):
    """A bitmap that has each key's bit set, of 16 bits a key between BITS and MOST_BITS; 1 where all are.

    It only saves work: whoever uses it joins by key afterwards, so a full one costs time, not rows.
    """
    import numpy as np

    keys = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    n, bits = keys.count(), BITS
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2

    def mark(batches):
        on = np.zeros(bits, bool)
        for batch in batches:
            on[batch.column(0).to_numpy() % bits] = True
        packed = np.packbits(on)
        for k in range(0, len(packed), 4096):
            if packed[k : k + 4096].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // 4096], pa.int32()), pa.array([packed[k : k + 4096].tobytes()], pa.binary())], names=["k", "bits"])

    out = np.zeros(bits // 8, np.uint8)

    def union(pdf):
        import pandas as pd

        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    for r in keys.mapInArrow(mark, "k int, bits binary").groupBy("k").applyInPandas(union, "k int, bits binary").collect():  # MOST_BITS bounds the rows
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def split_by_bitmap(df: DataFrame, key: Column, bitmap) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be among those of a bitmap, and rows whose key surely isn't; rows aren't moved.

    Join the former by an outer join: Catalyst moves a semi or anti join below this one, where all rows would be shuffled.
    The bitmap is sent to all tasks as rows of 4 KiB, which MOST_BITS bounds.
    """
    import numpy as np

    words = np.packbits(np.unpackbits(bitmap), bitorder="little").view("<i8").reshape(-1, 512)
    rows = pa.table({"__k": pa.array(range(len(words)), pa.int64()), "__words": pa.array(list(words), pa.list_(pa.int64()))})
    sent = F.broadcast(df.sparkSession.createDataFrame(rows))
    place = F.pmod(key, F.lit(8 * len(bitmap)).cast("long"))
    met = df.withColumn("__at", place).join(sent, F.shiftright("__at", 15) == F.col("__k"))
    on = F.getbit(F.get("__words", F.shiftright(F.col("__at") % 32768, 6).cast("int")), (F.col("__at") % 64).cast("int")) == 1
    return tuple(met.where(x).drop("__at", "__k", "__words") for x in (on, ~on))


def maybe_in(df: DataFrame, key: Column, bitmap) -> DataFrame:
    """Rows of df whose key may be among those of a bitmap; none of those is missing."""
    return split_by_bitmap(df, key, bitmap)[0]
