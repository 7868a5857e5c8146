"""Where the work on each file stands: a state for each file, kept over a stream of events, with a timer for silence.

A ``start`` begins a run at 5 percent. ``parse`` steps lead from 10 to 49, ``index`` steps from 70 to 89, ``done`` ends a run
at 100, ``fail`` ends it where it is. Progress doesn't fall within a run; what comes after its end is left out until the next
start. A run that hears nothing for STALL milliseconds has stalled, once for each silence; a timer on event time tells that
without an event. State is a few numbers a file; events of a file come in order of time within the watermark's delay. Files
are dealt into SHARDS, which are called as one, because a call takes some milliseconds however little it does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import fresh_dir

# The steps of progress.
STARTED, PARSE, INDEX, DONE = 5, (10, 49), (70, 89), 100
PARSE_STEP, INDEX_STEP = 13, 10
STALL = 24 * 3_600_000
SHARDS = 2048

OUT = "file_id bigint, seq bigint, run bigint, status string, progress int, failures bigint, stalls bigint"
_FIELDS = "seq bigint, run bigint, status string, progress int, failures bigint, stalls bigint, parse bigint, index bigint, last bigint"
_STATE = "file_id array<bigint>, " + ", ".join(f"{c} array<{kind}>" for c, kind in (f.split() for f in _FIELDS.split(", ")))
_NEW = (0, 0, "pending", 0, 0, 0, 0, 0, None)


def advance(state: tuple, events: list[tuple[int, str]]) -> tuple:
    """The state after some events (milliseconds, kind) in order."""
    seq, run, status, progress, failures, stalls, parse, index, last = state
    for ms, kind in events:
        if status == "processing" and last is not None and ms - last > STALL:
            stalls += 1
        if kind == "start":
            run, status, progress, parse, index, last = run + 1, "processing", STARTED, 0, 0, ms
        elif status != "processing" and status != "stalled":
            continue
        else:
            status, last = "processing", ms
            if kind == "parse":
                progress, parse = max(progress, min(PARSE[1], PARSE[0] + PARSE_STEP * parse)), parse + 1
            elif kind == "index":
                progress, index = max(progress, min(INDEX[1], INDEX[0] + INDEX_STEP * index)), index + 1
            elif kind == "done":
                progress, status = DONE, "done"
            elif kind == "fail":
                failures, status = failures + 1, "failed"
    return seq + 1, run, status, progress, failures, stalls, parse, index, last


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    files = {f: now for f, *now in zip(*state.get)} if state.exists else {}
    events: dict = {}
    if not state.hasTimedOut:
        for pdf in parts:
            for file, none, ms, order, kind in zip(*[pdf[c].tolist() for c in ("file_id", "none", "ms", "event_id", "kind")]):
                events.setdefault(None if none else file, []).append((ms, order, kind))
    for file, own in events.items():
        files[file] = advance(files.get(file, _NEW), [(ms, kind) for ms, _, kind in sorted(own)])
    mark, due, changed = state.getCurrentWatermarkMs(), None, list(events)
    for file, now in files.items():
        if now[2] != "processing":
            continue
        end = now[8] + STALL
        if end >= mark:
            due = end if due is None else min(due, end)
            continue
        heard = file in events  # silent for so long already, or the timer has run out
        files[file] = (now[0] + (not heard), now[1], "stalled", *now[3:5], now[5] + 1, *now[6:])
        if not heard:
            changed.append(file)
    state.update(tuple(map(list, zip(*((f, *now) for f, now in files.items())))))
    if due is not None:
        state.setTimeoutTimestamp(max(due, mark + 1))
    columns = [c.split()[0] for c in OUT.split(", ")]
    out = pd.DataFrame([(f, *files[f][:6]) for f in changed], columns=columns)
    yield out.assign(file_id=pd.Series(changed, dtype=object))


def progress_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row for each change of a file's state; events are (event_id, ts, file_id, kind), a stream."""
    file = F.col("file_id").cast("bigint")
    rows = events.select(F.col("event_id").cast("bigint").alias("event_id"), "ts", F.coalesce(file, F.lit(0)).alias("file_id"), file.isNull().alias("none"), "kind", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64(file), F.lit(SHARDS)).alias("shard"))
    return rows.withWatermark("ts", delay).groupBy("shard").applyInPandasWithState(_step, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track(spark: SparkSession, stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Takes a stream of events to its present end and returns each file's last state; a later call goes on from there."""
    base = folder or fresh_dir(spark, "progress")
    query = progress_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(OUT).parquet(f"{base}/out")
    w = Window.partitionBy("file_id").orderBy(F.col("seq").desc(), F.col("stalls").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "seq")
