"""Size-tiered compaction of immutable shards under a versioned manifest.

``append`` writes what arrives as small Parquet shards, a file for each task. ``compact`` puts the shards into tiers by
the logarithm of their size and merges neighbours of a tier into one, up to the target size, until no tier has enough
of them. Each change is one new manifest version; it is committed by a rename that fails if that version exists, so
readers see all of a change or nothing, and of two writers one has to try again. Object stores without such a rename are
refused. ``vacuum`` removes versions, and shards that only these list, once they have been superseded for a grace period,
so a reader of a version has at least that long to end. Files that no manifest has listed may belong to a writer at work
and go after the same period.

Merging moves no rows between executors: a task gets the paths of a group, which the target size bounds, streams them
and writes one file. Where Arrow lacks a column's type or the file system, Spark reads the group's files and brings each
group to one task by a shuffle. The driver holds the list of shards alone, as any table format does.

Results for odd input: an empty append makes no shard and no version; rows are kept as they are, nulls, repeated rows,
very long texts and columns of any type and name included; a shard of over half the target is left alone; shards of one
age are ordered by path.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BATCH_ROWS, bound_batches, fresh_dir, open_fs, release

TARGET_BYTES = 32 * 2**20
RATIO = 4
MIN_MERGE = 2
#: Into how many arrivals a table is dealt; each is committed and compacted by itself.
ARRIVALS = 4
#: Superseded versions, and files that no manifest has listed, are left alone for so long.
GRACE_SECONDS = 7 * 86_400

#: File systems whose rename can't be relied on to fail if the target exists.
NO_RENAME = {"s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "obs", "wasb", "wasbs"}


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    added: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, ratio: int = RATIO) -> int:
    return int(math.log(max(size, 1), ratio))


def plan(shards: list[Shard], target: int = TARGET_BYTES, ratio: int = RATIO, least: int = MIN_MERGE) -> list[list[Shard]]:
    """Groups to merge: neighbours in age within a tier, least of them at least, up to the target together."""
    groups: list[list[Shard]] = []
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.added, s.path)):
        if s.bytes * 2 <= target:
            tiers.setdefault(tier(s.bytes, ratio), []).append(s)
    for t in sorted(tiers):
        held: list[Shard] = []
        for s in tiers[t]:
            if held and sum(x.bytes for x in held) + s.bytes > target:
                if len(held) >= least:
                    groups.append(held)
                held = []
            held.append(s)
        if len(held) >= least:
            groups.append(held)
    return groups


class ShardStore:
    """Shards below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.scheme = urlparse(folder).scheme
        if self.scheme in NO_RENAME:
            raise ValueError(f"manifests need an atomic rename, which {self.scheme} lacks")

    # manifest

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        jvm, fs = self._hadoop()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not fs.exists(at):
            return 0
        return max((int(x.getPath().getName()[1:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        jvm, fs = self._hadoop()
        source = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/v{version:010d}"))
        try:
            return [Shard(**json.loads(x)) for x in jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").splitlines()]
        finally:
            source.close()

    def commit(self, shards: list[Shard], base: int) -> int:
        """Makes shards version base + 1, or raises Conflict if there is one already."""
        jvm, fs = self._hadoop()
        P = jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(P(f"{self.folder}/manifest"))
        draft, final = P(f"{self.folder}/manifest/.draft-{uuid.uuid4().hex}"), P(f"{self.folder}/manifest/v{base + 1:010d}")
        out = fs.create(draft, False)
        out.write("".join(json.dumps(asdict(s)) + "\n" for s in shards).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # data

    def write(self, df: DataFrame) -> list[Shard]:
        """Writes df's rows as shards, a file for each task, which no manifest lists yet."""
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.folder}/data/{name}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.folder}/data/{name}")
        at = back.metadataColumn("_metadata")  # whatever df's columns are called
        got = back.select(at["file_name"].alias("f"), at["file_size"].alias("s")).groupBy("f", "s").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        return [Shard(f"{name}/{r['f']}", r["n"], r["s"], 0) for r in sorted(got, key=lambda r: r["f"])]

    def add(self, new: list[Shard]) -> int:
        """Commits written shards; returns the version, which is their age."""
        base = self.version()
        while new:
            try:
                return self.commit(self.shards(base) + [replace(s, added=base + 1) for s in new], base)
            except Conflict:
                base = self.version()
        return base

    def append(self, df: DataFrame) -> int:
        """Adds df's rows as new shards; returns the version."""
        return self.add(self.write(df))

    def _streamed(self, groups: list[list[Shard]], schema: StructType, target: pa.Schema) -> DataFrame:
        """The rows of each group in one task, which streams the group's files."""
        folder = f"{self.folder}/data"

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq

            fs, root = open_fs(folder)
            for batch in batches:
                for paths in batch.column("paths").to_pylist():
                    for path in paths:
                        with fs.open_input_file(f"{root}/{path}") as f:
                            # Spark's 96-bit timestamps hold microseconds
                            for part in pq.ParquetFile(f, coerce_int96_timestamp_unit="us", buffer_size=1 << 20).iter_batches(batch_size=BATCH_ROWS // 2):
                                yield from pa.Table.from_batches([part]).cast(target).to_batches()
                        release()

        rows = [(k, [s.path for s in g]) for k, g in enumerate(groups)]
        dealt = self.spark.createDataFrame(rows, "k int, paths array<string>").repartitionById(len(rows), "k")
        return dealt.select("paths").mapInArrow(stream, schema)

    def _shuffled(self, groups: list[list[Shard]], schema: StructType) -> DataFrame:
        """The rows of each group in one task, read by Spark and dealt by group."""
        rows, name = self._files(schema, [s for g in groups for s in g])
        of = self.spark.createDataFrame([(s.path, k) for k, g in enumerate(groups) for s in g], "path string, k int")
        met = rows.alias("r").join(of.alias("g"), F.col(f"r.`{name}`") == F.col("g.path"))
        return met.repartitionById(len(groups), F.col("g.k")).select(*[F.col(f"r.`{c}`") for c in schema.names])

    def merge_once(self, schema: StructType, target: int = TARGET_BYTES, ratio: int = RATIO) -> bool:
        """One round of compaction; False if there is nothing to merge."""
        base = self.version()
        groups = plan(self.shards(base), target, ratio)
        if not groups:
            return False
        arrow = arrow_types(schema) if self.scheme in ("", "file", "hdfs") else None
        written = self.write(self._shuffled(groups, schema) if arrow is None else self._streamed(groups, schema, arrow))
        # task k writes group k; a shard is as old as the oldest that went into it
        merged = [replace(s, added=min(x.added for x in groups[int(re.match(r"part-(\d+)", s.path.rpartition("/")[2])[1])])) for s in written]
        gone = {s.path for g in groups for s in g}
        while True:
            now = self.shards(base)
            if not gone <= {s.path for s in now}:
                raise Conflict("another compaction has taken these shards")
            try:
                self.commit([s for s in now if s.path not in gone] + merged, base)
                return True
            except Conflict:
                base = self.version()

    def compact(self, schema: StructType, target: int = TARGET_BYTES, ratio: int = RATIO) -> int:
        """Merges until there is nothing to merge; starts anew where another compaction was faster."""
        while True:
            try:
                if not self.merge_once(schema, target, ratio):
                    return self.version()
            except Conflict:
                pass

    def vacuum(self, keep: int = 1, grace: float = GRACE_SECONDS) -> None:
        """Deletes versions before the last keep ones that a later one has superseded for grace seconds, and their shards.

        Files that no manifest lists are left of failed work, or of a writer that hasn't committed yet; they go once they
        are older than that, too.
        """
        jvm, fs = self._hadoop()
        P = jvm.org.apache.hadoop.fs.Path
        last, before = self.version(), time.time() * 1000 - grace * 1000
        at = P(f"{self.folder}/manifest")
        since = {int(x.getPath().getName()[1:]): x.getModificationTime() for x in fs.listStatus(at) if x.getPath().getName().startswith("v")} if fs.exists(at) else {}
        versions = sorted(since)
        # a version is superseded by the commit of the next one
        old = {v for v, following in zip(versions, versions[1:]) if v <= last - keep and since[following] < before}
        live = {s.path for v in versions if v not in old for s in self.shards(v)}
        dead = {s.path for v in old for s in self.shards(v)} - live
        data = P(f"{self.folder}/data")
        for job in fs.listStatus(data) if fs.exists(data) else ():
            name, left = job.getPath().getName(), 0
            for x in fs.listStatus(job.getPath()):
                path = f"{name}/{x.getPath().getName()}"
                if not x.getPath().getName().startswith("part-"):
                    left += x.isDirectory() and x.getModificationTime() >= before  # a writer's own folder
                elif path in dead or path not in live and x.getModificationTime() < before:
                    fs.delete(x.getPath(), False)
                else:
                    left += 1
            if not left and (any(p.startswith(name) for p in dead) or job.getModificationTime() < before):
                fs.delete(job.getPath(), True)
        for v in old:
            fs.delete(P(f"{self.folder}/manifest/v{v:010d}"), False)

    def _files(self, schema: StructType, shards: list[Shard]) -> tuple[DataFrame, str]:
        """The rows of shards and the name of the column that has their shard."""
        name = "_shard"
        while name in schema.names:
            name += "_"
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("string")), name
        df = self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{s.path}" for s in shards])
        return df.withColumn(name, F.regexp_extract(df.metadataColumn("_metadata")["file_path"], r"([^/]+/[^/]+)$", 1)), name

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """All rows of a version, with the shard each is in (column _shard, or _shard_ if docs have that name)."""
        return self._files(schema, self.shards(self.version() if version is None else version))[0]


def arrow_types(schema: StructType) -> pa.Schema | None:
    """The Arrow types of a schema's columns, or None if Arrow lacks one of them."""
    from pyspark.errors import PySparkException
    from pyspark.sql.pandas.types import to_arrow_schema

    try:
        return pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    except (PySparkException, NotImplementedError, TypeError):
        return None


def shard(docs: DataFrame, target: int = TARGET_BYTES, ratio: int = RATIO, folder: str | None = None, arrivals: int = ARRIVALS) -> tuple[ShardStore, DataFrame]:
    """Adds docs to a store in a number of arrivals, compacting after each; returns the store and its rows with their shards.

    The rows are written once, as small immutable shards; each arrival is the commit of a run of them.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, folder or fresh_dir(spark, "shards"))
    bound_batches(spark)
    written = store.write(docs)
    step = max(1, -(-len(written) // arrivals))
    for k in range(0, len(written), step):
        store.add(written[k : k + step])
        store.compact(docs.schema, target, ratio)
    store.vacuum()
    return store, store.read(docs.schema)


def placed(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id of each row with its shard, the shard's rows, bytes and tier, and the manifest version."""
    store, rows = shard(docs, **parameters)
    version = store.version()
    listed = [(s.path, s.rows, s.bytes, tier(s.bytes), version) for s in store.shards()]
    info = docs.sparkSession.createDataFrame(listed, "shard string, shard_rows long, shard_bytes long, shard_tier int, version int")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(rows.columns[-1]).alias("shard")).join(info, "shard").select("doc_id", "shard", "shard_rows", "shard_bytes", "shard_tier", "version")
