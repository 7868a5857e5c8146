"""A cache of results over a stream of requests: entries live for a time, and the least recently used ones go first.

Keys are dealt into shards by hash; a shard's state is its entries in the order of use, ``most`` at most, so state is
bounded and no task sees all keys. An entry lives for ``ttl`` milliseconds from when it was put, however often it is read.
An event that invalidates a file goes to all shards and removes the results that the file took part in.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import fresh_dir

# How long a result lives, and how many there are.
TTL, MOST = 3_600_000, 1000

OUT = "event_id bigint, key string, hit boolean"
_STATE = "keys array<string>, files array<string>, until array<bigint>"


class Shard:
    """Entries (files, end of life) by key, the least recently used one first."""

    def __init__(self, ttl: int, most: int, entries: Iterable[tuple[str, str, int]] = ()):
        self.ttl, self.most = ttl, most
        self.entries = OrderedDict((k, (f, u)) for k, f, u in entries)

    def request(self, ms: int, key: str, files: str) -> bool:
        """Whether a result is there; if not, it is put."""
        held = self.entries.get(key)
        if held and ms < held[1]:
            self.entries.move_to_end(key)
            return True
        self.entries.pop(key, None)
        self.entries[key] = (files, ms + self.ttl)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)
        return False

    def invalidate(self, file: str) -> None:
        for k in [k for k, (f, _) in self.entries.items() if file in f.split(",")]:
            del self.entries[k]


def requests_stream(events: DataFrame, ttl: int = TTL, most: int = MOST, shards: int = 64) -> DataFrame:
    """event_id, key and hit of each request; events are (event_id, ts, key, files, kind), kind is request or invalidate.

    ``files`` are the ids of a result's files, joined by commas, or the one that is invalidated. ``most`` is for each shard.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = Shard(ttl, most, zip(*state.get) if state.exists else ())
        rows = sorted(r for pdf in parts for r in zip(pdf["ms"], pdf["event_id"], pdf["kind"], pdf["key"], pdf["files"]))
        out = []
        for ms, event, kind, name, files in rows:
            if kind == "invalidate":
                shard.invalidate(files)
            else:
                out.append((event, name, shard.request(int(ms), name, files)))
        held = shard.entries
        state.update(([*held], [f for f, _ in held.values()], [int(u) for _, u in held.values()]))
        yield pd.DataFrame(out, columns=["event_id", "key", "hit"])

    own = F.when(F.col("kind") == "invalidate", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")))
    rows = events.select(F.col("event_id").cast("bigint").alias("event_id"), F.unix_millis("ts").alias("ms"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("files", F.lit("")).alias("files"), "kind", F.explode(own).alias("shard"))
    return rows.groupBy("shard").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, stream: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """Takes a stream of requests to its present end; a later call goes on with the same entries."""
    base = folder or fresh_dir(spark, "cache")
    query = requests_stream(stream, **parameters).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")
