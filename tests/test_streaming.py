from lakequill.api import Workspace
from lakequill.streaming.ingest import ChunkStore

TEXT = {1: "# 合同\n\n合同金额为500万元。\n\n甲方为北京星海科技有限公司", 2: "付款方式\n\n首付款30%。合同金额为480万元。", 3: "无关的内容"}


def files(spark, ids, extra=""):
    return spark.createDataFrame([(i, TEXT[i] + extra) for i in ids], "file_id bigint, text string")


def test_merge_replaces_adds_and_deletes(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/w")
    store.merge(files(spark, [1, 2]))
    store.merge(files(spark, [2, 3], " neu"))
    got = {r["file_id"]: r["content"] for r in store.read().collect()}
    assert set(got) == {1, 2, 3} and "neu" in got[2] and "neu" not in got[1]
    store.merge(files(spark, [1], " nochmal"), force=False)
    assert "nochmal" not in {r["file_id"]: r["content"] for r in store.read().collect()}[1]
    store.delete(files(spark, [1]).select("file_id"))
    assert {r["file_id"] for r in store.read().collect()} == {2, 3}


def test_stream_equals_batch(spark, tmp_path):
    files(spark, [1, 2, 3]).write.parquet(f"{tmp_path}/in/a")
    store = ChunkStore(spark, f"file://{tmp_path}/w")
    stream = spark.readStream.schema("file_id bigint, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store.ingest(stream)
    want = store.chunk(files(spark, [1, 2, 3])).select("file_id", "chunk_id", "content")
    key = lambda r: tuple(r)
    assert sorted(map(key, store.read().select("file_id", "chunk_id", "content").collect())) == sorted(map(key, want.collect()))


def test_ask_fill_and_operate(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.ingest(files(spark, [1, 2, 3]))
    got = w.ask("合同金额为500万元")
    assert got["sources"] and 0.15 <= got["confidence"] <= 0.95 and {c["kind"] for c in got["conflicts"]} >= {"金额"}
    assert {s["file_id"] for s in w.ask("合同", [2])["sources"]} == {2}
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 50)], "id int, N_Name string, qty int")
    cells = w.fill(table, ["n name", "qty"], "id", "qty大于10").collect()
    assert sorted((r["place"], r["field"], r["value"]) for r in cells) == [(1, "n name", "b"), (1, "qty", "50")]
    assert w.operate(table, "筛选qty大于10的行").count() == 1
    assert w.summary(3) == "无关的内容..."
    assert [(r["file_id"], r["n_chunks"]) for r in w.files().collect()] == [(1, 1), (2, 1), (3, 1)]
    assert w.preview(table, "删除qty大于10的行", "id").first()["n"] == 1
    w.split(table, "id", 1, f"{tmp_path}/parts")
    assert spark.read.parquet(f"{tmp_path}/parts").select("part").distinct().count() == 2
    paras = spark.createDataFrame([(1, k, "段落内容足够长的一个正文句子啊啊", "Normal", False) for k in range(6)], "doc_id bigint, ordinal bigint, text string, style string, bold boolean")
    assert w.extract(paras, "body").count() == 4
    assert w.operate(paras, "删除第一段").count() == 5
    w.delete([1, 2, 3])
    w.ingest(files(spark, [2]))
    assert [r["file_id"] for r in w.files().collect()] == [2]


def test_retrieve_finds_texts_without_spaces_in_order_of_novelty(spark, tmp_path):
    from lakequill.api import Workspace

    work = Workspace(spark, f"file://{tmp_path}/w")
    texts = ["合同金额为五百万元，签订日期见首页。", "合同金额为五百万元，签订日期见附件。", "今天的天气很好，适合散步。", "plain words about something else"]
    work.ingest(spark.createDataFrame(list(enumerate(texts)), "file_id bigint, text string"))
    got = [r["content"] for r in work.retrieve("合同的签订日期", k=2).collect()]
    assert len(got) == 2 and any(t in got[0] for t in texts[:2])
    few = work.retrieve("合同的签订日期", k=8).collect()
    assert {r["rerank_score"] for r in few} == {None} and len({r["chunk_id"] for r in few}) == len(few)


def test_progress_goes_on_where_it_stopped(spark, data_dir, tmp_path):
    """One go over all events, and three goes with new files in between, tell the same of each file."""
    from lakequill.plans.files import SLICES, _event_files
    from lakequill.streaming import progress

    def states(name, cuts):
        folder, got = f"file://{tmp_path}/{name}", None
        for a, b in zip(cuts, cuts[1:]):
            stream = spark.readStream.schema("event_id bigint, ts timestamp, file_id bigint, kind string").option("maxFilesPerTrigger", 1).parquet(_event_files(spark, data_dir, folder, a, b))
            got = sorted(map(tuple, progress.track(spark, stream, folder).collect()))
        return got

    whole = states("whole", [0, SLICES])
    assert whole == states("parts", [0, 1, 3, SLICES]) and sum(r[5] for r in whole) > 0


def test_steps_of_progress():
    from lakequill.streaming.progress import STALL, advance

    state = (0, 0, "pending", 0, 0, 0, 0, 0, None)
    assert advance(state, [(1, "parse"), (2, "done")])[1:4] == (0, "pending", 0)
    state = advance(state, [(1, "start"), (2, "parse"), (3, "parse"), (4, "index"), (5, "parse")])
    assert state[:4] == (1, 1, "processing", 70)
    late = advance(state, [(6 + STALL + 5, "fail"), (7 + STALL + 5, "done")])
    assert late[2:6] == ("failed", 70, 1, 1)
    assert advance(late, [(10**12, "start"), (10**12 + 1, "done")])[1:6] == (2, "done", 100, 1, 1)


def test_files_of_a_shard_come_in_one_call():
    import pandas as pd

    from lakequill.streaming import progress

    class State:
        exists = hasTimedOut = False
        mark, timer = 0, None
        update = lambda self, got: self.__dict__.update(get=got, exists=True)
        getCurrentWatermarkMs = lambda self: self.mark
        setTimeoutTimestamp = lambda self, ms: self.__dict__.update(timer=ms)

    def call(state, rows):
        parts = [pd.DataFrame(rows, columns=["file_id", "none", "ms", "event_id", "kind"])] if rows else []
        return sorted((tuple(r) for pdf in progress._step((0,), iter(parts), state) for r in pdf.astype(object).values.tolist()), key=str)

    big, s = 2**60 + 1, State()
    got = call(s, [(big, False, 7, 2, "parse"), (0, True, 5, 3, "start"), (big, False, 6, 1, "start"), (9, False, 1, 4, "done"), (8, False, 1, 5, "start"), (8, False, 2, 6, "done")])
    assert got == sorted([(big, 1, 1, "processing", 10, 0, 0), (None, 1, 1, "processing", 5, 0, 0), (9, 1, 0, "pending", 0, 0, 0), (8, 1, 1, "done", 100, 0, 0)], key=str)
    assert s.timer == 5 + progress.STALL
    s.hasTimedOut, s.mark = True, 6 + progress.STALL  # only the file of the timer has been silent for long enough
    assert call(s, []) == [(None, 2, 1, "stalled", 5, 0, 1)] and s.timer == 7 + progress.STALL


def test_a_slice_of_events_may_be_many_files(spark, data_dir, monkeypatch):
    import compare

    from lakequill.plans import catalog, files

    monkeypatch.setattr(files, "EVENTS_OF_FILE", 300)
    assert not compare.difference(catalog.queries()["task_progress"](spark, data_dir), compare.connect(data_dir), catalog.oracle_sql()["task_progress"])


def test_cache_forgets_by_time_use_and_file(spark, tmp_path):
    from lakequill.streaming.cache import Shard, replay

    shard = Shard(10, 2)
    assert [shard.request(ms, k, f) for ms, k, f in ((0, "a", "1,2"), (1, "b", "3"), (2, "a", ""), (3, "c", "12"), (4, "b", "3"), (9, "c", ""), (13, "c", "12"), (14, "b", "3"))] == [False, False, True, False, False, True, False, False]
    shard.invalidate("2")
    assert list(shard.entries) == ["c", "b"]
    shard.invalidate("12")
    assert list(shard.entries) == ["b"]
    ddl = "event_id bigint, ts timestamp, key string, files string, kind string"
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    one = [(1, at(1), "q1", "7,8", "request"), (2, at(2), "q1", "7,8", "request"), (3, at(3), "q2", "9", "request")]
    two = [(4, at(4), None, "8", "invalidate"), (5, at(5), "q1", "7,8", "request"), (6, at(6), "q2", "9", "request")]
    for rows in (one, two):  # a second go with the same folder keeps the entries
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = replay(spark, spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/c", shards=3)
    assert sorted((r["event_id"], r["hit"]) for r in got.collect()) == [(1, False), (2, True), (3, False), (5, False), (6, True)]
