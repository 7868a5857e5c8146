"""Tables of keyed rows with versions: replaced and deleted by key, read as of a version, never rewritten in place.

A change writes new Parquet folders and commits a manifest that names them, by a rename that fails if the version exists.
So a reader sees all of a change or nothing, keeps its version while others write, and of two writers one tries again on
top of the other. A batch costs its own rows: what it replaces is named in a list of keys, which readers leave out by an
anti-join, until a compaction has merged the parts. Parts are merged when the younger ones together have as many rows as
the one before, so a row is rewritten a logarithmic number of times.

``facts`` are what rows depend on, such as the dimension and name of an embedder. A table with other facts, or of another
format, isn't read or written as if they agreed: ``Changed`` is raised, and ``replace_all`` makes a version of new facts,
while those before stay as they are.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FORMAT = 1
#: Superseded versions and files of no version are left alone for so long.
GRACE_SECONDS = 7 * 86_400
#: File systems whose rename can't be relied on to fail if the target exists.
NO_RENAME = {"s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "obs", "wasb", "wasbs"}


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Changed(ValueError):
    """The stored rows are of another format or depend on other facts."""


@dataclass(frozen=True)
class Part:
    """A folder of rows; keys that later versions name don't count in it."""

    name: str
    added: int
    rows: int


@dataclass(frozen=True)
class Gone:
    """A folder of keys whose rows in parts before a version are replaced or deleted."""

    name: str
    before: int


@dataclass(frozen=True)
class State:
    version: int = 0
    parts: tuple[Part, ...] = ()
    gone: tuple[Gone, ...] = ()
    facts: dict = field(default_factory=dict)
    format: int = FORMAT


class SnapshotTable:
    """Rows below a folder, replaced by ``key``, laid out by the columns of ``layout`` and sorted by those of ``order`` in each file."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: str, layout: tuple[str, ...] = (), facts: dict | None = None, order: tuple[str, ...] = ()):
        if urlparse(folder).scheme in NO_RENAME:
            raise ValueError(f"versions need an atomic rename, which {urlparse(folder).scheme} lacks")
        self.spark, self.folder, self.key, self.layout, self.order = spark, folder.rstrip("/"), key, layout, order
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.facts = facts or {}

    # versions

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _listed(self, name: str) -> list:
        P, fs, _ = self._hadoop()
        at = P(f"{self.folder}/{name}")
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> dict[int, int]:
        """Versions that are there, with the time of their commit in milliseconds."""
        names = ((x.getPath().getName(), x.getModificationTime()) for x in self._listed("manifest"))
        return {int(n[1:]): t for n, t in names if n.startswith("v")}

    def state(self, version: int | None = None) -> State:
        """What a version consists of; the latest one by default, an empty one if there is none."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return State(facts=self.facts)
        P, fs, jvm = self._hadoop()
        stream = fs.open(P(f"{self.folder}/manifest/v{version:010d}"))
        try:
            got = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(got["version"], tuple(Part(**x) for x in got["parts"]), tuple(Gone(**x) for x in got["gone"]), got["facts"], got["format"])

    def check(self, state: State) -> State:
        """The state, if it can be read with this table's format and facts."""
        if state.version and state.format != FORMAT:
            raise Changed(f"stored in format {state.format}, not {FORMAT}")
        off = {k: (state.facts.get(k), v) for k, v in self.facts.items() if state.version and state.facts.get(k) != v}
        if off:
            raise Changed(f"stored facts differ: {off}")
        return state

    def commit(self, state: State) -> State:
        """Makes a state the version after the one it was made from, or raises Conflict if there is one already."""
        state = replace(state, version=state.version + 1)
        P, fs, jvm = self._hadoop()
        fs.mkdirs(P(f"{self.folder}/manifest"))
        draft, final = P(f"{self.folder}/manifest/.draft-{uuid.uuid4().hex}"), P(f"{self.folder}/manifest/v{state.version:010d}")
        out = fs.create(draft, False)
        out.write(json.dumps(asdict(state)).encode())
        out.close()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {state.version} exists") from e
            raise
        return state

    # rows

    def _write(self, rows: DataFrame) -> Part:
        """Rows in a new folder, which no version names yet."""
        name = uuid.uuid4().hex
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])
        if self.layout or self.order:
            # rows of a folder, or of near keys, come together, those of large ones in several tasks
            rows = rows.hint("rebalance", *self.layout) if self.layout else rows.repartitionByRange(*self.order)
            rows = rows.sortWithinPartitions(*self.layout, *self.order)
        writer = rows.write.partitionBy(*self.layout) if self.layout else rows.write
        writer.parquet(f"{self.folder}/data/part={name}")
        return Part(name, 0, self._read([name]).count())

    def _write_keys(self, keys: DataFrame) -> str:
        name = uuid.uuid4().hex
        keys.select(F.col(f"`{self.key}`").cast(self.schema[self.key].dataType)).distinct().write.parquet(f"{self.folder}/gone/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("part", StringType())])
        if not names:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/part={n}" for n in names])

    def _live(self, parts: tuple[Part, ...], gone: tuple[Gone, ...]) -> DataFrame:
        """Rows of parts without the keys that later versions name; parts that no such version touches aren't joined."""
        columns = [f"`{f.name}`" for f in self.schema.fields]
        last = max((g.before for g in gone), default=0)
        old, new = [p for p in parts if p.added < last], [p for p in parts if p.added >= last]
        out = self._read([p.name for p in new]).select(*columns)
        if not old:
            return out
        age = F.create_map(*[F.lit(x) for p in old for x in (p.name, p.added)])
        rows = self._read([p.name for p in old]).withColumn("__added", age[F.col("part")])
        kind = StructType([self.schema[self.key]])
        named = [self.spark.read.schema(kind).parquet(f"{self.folder}/gone/{g.name}").withColumn("__before", F.lit(g.before)) for g in gone]
        named = reduce(DataFrame.unionByName, named).groupBy(self.key).agg(F.max("__before").alias("__before")).withColumnRenamed(self.key, "__gone")
        rows = rows.join(named, (F.col(f"`{self.key}`") == F.col("__gone")) & (F.col("__before") > F.col("__added")), "left_anti").select(*columns)
        return rows.unionByName(out) if new else rows

    def read(self, version: int | None = None) -> DataFrame:
        state = self.check(self.state(version))
        return self._live(state.parts, state.gone)

    def _change(self, part: Part | None, gone: str | None, check: bool = True) -> State:
        while True:
            base = self.state()
            if check:
                self.check(base)
            at = base.version + 1
            parts = base.parts + ((replace(part, added=at),) if part and part.rows else ())
            dead = base.gone + ((Gone(gone, at),) if gone and base.parts else ())
            try:
                return self.commit(replace(base, parts=parts, gone=dead, facts=base.facts | self.facts))
            except Conflict:
                pass

    def upsert(self, rows: DataFrame, keys: DataFrame | None = None) -> State:
        """Adds rows, in place of all rows that have one of their keys (or of the keys that are named)."""
        self.check(self.state())
        part = self._write(rows)
        kept = self._read([part.name])
        state = self._change(part, self._write_keys(kept if keys is None else keys))
        while self._merge_due(state.parts):
            if not (merged := self.merge(state)):
                break
            state = merged
        return state

    def delete(self, keys: DataFrame) -> State:
        return self._change(None, self._write_keys(keys))

    def replace_all(self, rows: DataFrame) -> State:
        """A version of these rows alone, under this table's facts; the versions before stay what they are."""
        part = self._write(rows)
        while True:
            base = self.state()
            try:
                return self.commit(State(base.version, (replace(part, added=base.version + 1),) if part.rows else (), (), self.facts))
            except Conflict:
                pass

    @staticmethod
    def _merge_due(parts: tuple[Part, ...]) -> int:
        """How many of the youngest parts are to be merged: those that have as many rows as the one before; 0 if none."""
        total, most = 0, 0
        for k, p in enumerate(reversed(parts)):
            if k and total >= p.rows:
                most = k + 1
            total += p.rows
        return most

    def merge(self, state: State | None = None, whole: bool = False) -> State | None:
        """Merges the youngest parts, or all, into one without the rows that are gone; None if another merge was faster."""
        state = state or self.state()
        n = len(state.parts) if whole else self._merge_due(state.parts)
        if not n:
            return state
        own = state.parts[-n:]
        made = self._write(self._live(own, state.gone))
        while True:
            base = self.state()
            if not {p.name for p in own} <= {p.name for p in base.parts}:
                return None
            names = {p.name for p in own}
            parts = [p for p in base.parts if p.name not in names]
            if made.rows:
                parts = sorted([*parts, replace(made, added=state.version)], key=lambda p: p.added)
            oldest = min((p.added for p in parts), default=base.version + 1)
            try:
                return self.commit(replace(base, parts=tuple(parts), gone=tuple(g for g in base.gone if g.before > oldest)))
            except Conflict:
                pass

    def vacuum(self, keep: int = 1, grace: float = GRACE_SECONDS) -> None:
        """Deletes versions that have been superseded for grace seconds, but for the last ones, and what only these name."""
        P, fs, _ = self._hadoop()
        since, before = self.versions(), (time.time() - grace) * 1000
        ordered = sorted(since)
        old = [v for v, following in zip(ordered, ordered[1:]) if v <= ordered[-1] - keep and since[following] < before]
        kept = [self.state(v) for v in ordered if v not in old]
        named = {f"part={p.name}" for s in kept for p in s.parts} | {g.name for s in kept for g in s.gone}
        dropped = [self.state(v) for v in old]
        dead = {f"part={p.name}" for s in dropped for p in s.parts} | {g.name for s in dropped for g in s.gone}
        for name in ("data", "gone"):
            for x in self._listed(name):
                own = x.getPath().getName()
                # what no version names is a writer's, at work or failed
                if own not in named and (own in dead or x.getModificationTime() < before):
                    fs.delete(x.getPath(), True)
        for v in old:
            fs.delete(P(f"{self.folder}/manifest/v{v:010d}"), False)
