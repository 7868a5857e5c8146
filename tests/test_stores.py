"""Versioned tables and stored indexes: readers and writers side by side, guards, recall and what a search reads."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.api import Workspace
from lakequill.models import HashingEmbedder
from lakequill.operators import retrieval
from lakequill.stores.postings import KeywordIndex
from lakequill.stores.snapshots import Changed, Conflict, Part, SnapshotTable, State
from lakequill.stores.vectors import VectorIndex


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k bigint, v string")


def held(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def kept(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t", "k bigint, v string", "k")


def test_a_reader_keeps_its_version(spark, kept):
    kept.upsert(rows(spark, [(i, "a") for i in range(100)]))
    reader = kept.read()
    assert reader.count() == 100
    kept.upsert(rows(spark, [(1, "b"), (1, "c"), (200, "n")]))
    kept.delete(rows(spark, [(2, "")]).select("k"))
    now = held(kept.read())
    assert len(now) == 101 and (1, "b") in now and (1, "c") in now and (1, "a") not in now and (2, "a") not in now
    kept.merge(whole=True)
    kept.vacuum()
    assert held(kept.read()) == now and len(kept.state().parts) == 1 and not kept.state().gone
    assert reader.count() == 100 and held(kept.read(1)) == held(reader)
    kept.vacuum(grace=-60)
    assert held(kept.read()) == now
    with pytest.raises(Exception, match="(?i)not.?exist|not found"):
        kept.read(1).count()


def test_of_two_writers_one_goes_on_top_of_the_other(spark, kept, tmp_path, monkeypatch):
    kept.upsert(rows(spark, [(1, "a")]))
    other = SnapshotTable(spark, f"file://{tmp_path}/t", "k bigint, v string", "k")
    with pytest.raises(Conflict):
        kept.commit(State())
    states = iter([kept.state()])  # a writer that has read the state before the other has committed
    other.upsert(rows(spark, [(2, "b")]))
    monkeypatch.setattr(kept, "state", lambda version=None: next(states, None) or SnapshotTable.state(kept, version))
    kept._change(kept._write(rows(spark, [(3, "c")])), None)
    assert held(other.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_merge_leaves_what_came_meanwhile(spark, kept):
    kept.upsert(rows(spark, [(i, "a") for i in range(40)]))
    state = kept.upsert(rows(spark, [(0, "b")]))
    late = rows(spark, [(1, "late")])
    kept._change(kept._write(late), kept._write_keys(late))
    assert kept.merge(state, whole=True) is not None
    now = dict(held(kept.read()))
    assert now[0] == "b" and now[1] == "late" and len(now) == 40
    assert kept.merge(state, whole=True) is None  # its parts are merged already


def test_parts_are_merged_by_size(spark, kept):
    assert SnapshotTable._merge_due(tuple(Part(str(n), 1, n) for n in (100, 10, 1))) == 0
    assert SnapshotTable._merge_due(tuple(Part(str(n), 1, n) for n in (100, 10, 5, 5))) == 3
    for k in range(9):
        kept.upsert(rows(spark, [(k, "x")]))
    assert len(kept.state().parts) <= 4 and kept.read().count() == 9


def test_other_facts_and_formats_are_refused_and_nothing_is_wiped(spark, kept, tmp_path):
    kept.facts = {"dimension": 3}
    kept.upsert(rows(spark, [(1, "a")]))
    other = SnapshotTable(spark, f"file://{tmp_path}/t", "k bigint, v string", "k", facts={"dimension": 4})
    for refused in (other.read, lambda: other.upsert(rows(spark, [(2, "b")])), lambda: other.delete(rows(spark, [(1, "")]).select("k"))):
        with pytest.raises(Changed):
            refused()
    assert held(kept.read()) == [(1, "a")]
    other.replace_all(rows(spark, [(9, "z")]))
    assert held(other.read()) == [(9, "z")] and held(kept.read(1)) == [(1, "a")]
    with pytest.raises(Changed):
        kept.read()
    with pytest.raises(ValueError, match="rename"):
        SnapshotTable(spark, "s3a://bucket/x", "k bigint", "k")


def clustered(spark, n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (20, dim))
    v = centres[r.integers(0, 20, n)] + r.normal(0, 0.3, (n, dim))
    return v, spark.createDataFrame([(i, i % 10, "l", [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, file_id bigint, label string, embedding array<double>")


@pytest.mark.parametrize("n", [300, 4000])
def test_recall_exactness_and_pruning_of_vectors(spark, tmp_path, n):
    v, df = clustered(spark, n)
    index = VectorIndex(spark, f"file://{tmp_path}/v", id_type="bigint")
    index.build(df, cells=32)
    hit = 0
    for q in range(0, n, n // 8):
        want = np.lexsort((np.arange(n), ((v - v[q]) ** 2).sum(1)))[:10].tolist()
        near = index.search(v[q].tolist(), 10, probes=4)
        hit += len({r["id"] for r in near.collect()} & set(want))
        assert [r["id"] for r in index.search(v[q].tolist(), 10, probes=2, exact=True).collect()] == want
    assert hit >= 0.9 * 10 * len(range(0, n, n // 8))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)
    read, cells = index.cells_read(v[0].tolist(), 10, probes=4)
    assert read < cells == 32


def test_vectors_are_replaced_by_file_and_guarded(spark, tmp_path):
    v, df = clustered(spark, 500)
    index = VectorIndex(spark, f"file://{tmp_path}/v", {"embedder": "a"}, id_type="bigint")
    index.build(df)
    index.upsert(df.where("file_id = 3").withColumn("embedding", F.transform("embedding", lambda x: x + 100)))
    index.delete(spark.createDataFrame([(4,)], "file_id bigint"))
    found = {r["id"] % 10 for r in index.search(v[3].tolist(), 60, exact=True).collect()}
    assert 3 not in found and 4 not in found and index.rows().count() == 450
    with pytest.raises(Changed):
        index.search([1.0, 2.0], 3)
    with pytest.raises(Changed):
        VectorIndex(spark, f"file://{tmp_path}/v", {"embedder": "b"}, id_type="bigint").search(v[0].tolist(), 3)
    with pytest.raises(Exception, match="dimensions"):
        index.upsert(spark.createDataFrame([(1, 1, "l", [1.0])], "id bigint, file_id bigint, label string, embedding array<double>"))
    assert index.rows().count() == 450
    assert index.search(v[0].tolist(), 1000, exact=True).count() == 450


TEXTS = [("red apple pie", 1), ("green apple", 1), ("red red wine", 2), ("nothing here", 2), (None, 3), ("", 3), ("apple " * 50, 4)]


def test_keyword_search_reads_its_terms_and_stops_early(spark, tmp_path):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    made = [(i, i % 5, " ".join(r.choice(words, 30)) + (" rare rare rare" if i in (17, 1203) else " rare" if i % 400 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(made, "id bigint, file_id bigint, text string")
    index = KeywordIndex(spark, f"file://{tmp_path}/k", id_type="bigint")
    index.build(docs)
    for terms, k in ((["rare"], 2), (["rare", "w3"], 5), (["w1", "w2", "absent"], 8), ([], 3), (["absent"], 3)):
        want = retrieval.bm25(docs, "id", "text", terms).orderBy(F.col("score").desc(), "id").limit(k).select("id", F.round("score", 9))
        assert list(map(tuple, index.search(terms, k).select("id", F.round("score", 9)).collect())) == list(map(tuple, want.collect())), terms
    scored, of = index.blocks_read(["rare", "w3"], 2)
    assert scored < of
    plan = index.rows("posting", ["rare"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in plan


def test_keyword_scores_of_odd_and_replaced_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f, t) for i, (t, f) in enumerate(TEXTS)], "id bigint, file_id bigint, text string")
    index = KeywordIndex(spark, f"file://{tmp_path}/k", id_type="bigint")
    index.build(docs)
    assert index.statistics()[0] == len(TEXTS)
    index.upsert(spark.createDataFrame([(50, 1, "blue plum")], "id bigint, file_id bigint, text string"))
    index.delete(spark.createDataFrame([(4,)], "file_id bigint"))
    now = spark.createDataFrame([(i, t) for i, (t, f) in enumerate(TEXTS) if f not in (1, 4)] + [(50, "blue plum")], "id bigint, text string").na.fill("")
    for terms in (["apple"], ["red", "plum"]):
        want = retrieval.bm25(now, "id", "text", terms).orderBy(F.col("score").desc(), "id").limit(4).select("id", F.round("score", 9))
        assert list(map(tuple, index.search(terms, 4).select("id", F.round("score", 9)).collect())) == list(map(tuple, want.collect()))
    assert held(index.scores(["plum"], spark.createDataFrame([(50,), (2,)], "id bigint")).select("id")) == [(50,)]


def test_a_question_embeds_itself_alone_and_another_embedder_is_refused(spark, tmp_path):
    files = spark.createDataFrame([(1, "The contract amount is 500.\nSigned in May."), (2, "The weather is fine.")], "file_id bigint, text string")
    calls = []

    class Counting(HashingEmbedder):
        def encode(self, texts):
            calls.extend(texts)
            return super().encode(texts)

    w = Workspace(spark, f"file://{tmp_path}/w", Counting())
    w.ingest(files)
    calls.clear()
    assert w.retrieve("contract amount", k=1).first()["file_id"] == 1
    assert calls == ["contract amount"]
    w.ingest(spark.createDataFrame([(1, "Nothing of the kind.")], "file_id bigint, text string"))
    assert {r["file_id"] for r in w.retrieve("weather", [2]).collect()} == {2}
    other = Workspace(spark, f"file://{tmp_path}/w", Counting(32))
    for refused in (lambda: other.retrieve("weather"), lambda: other.ingest(files)):
        with pytest.raises(Changed):
            refused()
    assert w.store.read().count() == 2
    other.rebuild()
    assert other.retrieve("weather", k=1).first()["file_id"] == 2
