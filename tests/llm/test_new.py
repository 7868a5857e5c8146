"""Fill-in-the-middle, vector codes and repeated passages against brute force, and faults that were mended."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.llm import codes, infill, langid, matroska, mixing, neardup, repeats, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = r"\x20\x09-\x0D"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=str)


# 11 fill-in-the-middle

TEXTS = ["a\nb\n", "\n\n", "x", "", "a\n\nb", None, "😀\n😀😀 b c1 2d", " lead  two\tthree\n four ", "<P>x\n", "end<\n<S", "éa. Bc!\nXy? z", "日本。語 a", "ab<\nM>c\n", "line\n" * 20_000, "y" * 300_000]
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": f"[{SPACE}]+(?=[^{SPACE}]|$)|[^{SPACE}]+[{SPACE}]*", "characters": r"[\s\S]", "runs": f"[{SPACE}]+|[^{SPACE}]+"}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "d", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0], None, None), (None, TEXTS[0], "d", 1), (0, TEXTS[0], "d", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, units string, n int").cache()


@pytest.mark.parametrize("grammar", sorted(infill.GRAMMARS))
def test_units_join_to_the_text_and_follow_their_grammar(texts, grammar):
    for r in texts.where("length(text) < 100 OR text IS NULL").select("text", infill.units(F.col("text"), grammar).alias("u")).collect():
        assert "".join(r["u"]) == (r["text"] or "")
        if grammar in UNITS:
            assert r["u"] == re.findall(UNITS[grammar], r["text"] or "")


def brute_infill(i, t, seed, rate, spm):
    t = t or ""
    u = re.findall(UNITS["lines"], t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (1, 60, 0), (2, 0, 50), (3, 100, 100)])
def test_cuts_forms_and_restored_texts(texts, seed, rate, spm):
    got = infill.digests(texts, seed=seed, rate=rate, spm_rate=spm).collect()
    want = []
    for r in texts.collect():
        n, form, p, m, out = brute_infill(r["doc_id"], r["text"], seed, rate, spm)
        want.append((r["doc_id"], n, form, p, m, sha(out), sha(r["text"] or "")))
    assert in_order(map(tuple, got)) == in_order(want)
    assert infill.digests(texts.limit(0)).count() == 0


def test_infill_stays_in_the_jvm_without_a_shuffle(texts):
    plan = infill.digests(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan


# 12 vector codes


def brute_codes(rows, rounds=codes.ROUNDS):
    kept = sorted(((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    wide = -(-dim // 8)
    cells = [[int(np.floor(float(x) * 4096)) for x in v] + [0] * (8 * wide - dim) for _, v, _ in kept if len(v) == dim]
    parts = [[c[p * wide : p * wide + wide] for c in cells] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            of = [nearest(p, x)[1] for x in parts[p]]
            for k in range(len(books[p])):
                own = [x for x, o in zip(parts[p], of) if o == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    out, n = [], iter(range(len(cells)))
    for i, v, lab in kept:
        if len(v) != dim:
            out.append([i, None, None, lab])
            continue
        at = next(n)
        got = [nearest(p, parts[p][at]) for p in range(8)]
        out.append([i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab])
    total = {}
    for _, _, e, lab in out:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    fits = lambda x: x if x is None or x < 2**63 else None
    return [(i, c, fits(e), fits(total.get(lab)), digest) for i, c, e, lab in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, m int"


def embedded(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (5, dim))
    v = (centres[r.integers(0, 5, n)] + r.normal(0, spread, (n, dim))).astype(np.float32)
    return [(int(i), [float(x) for x in row], int(r.integers(0, 4)) if r.random() < 0.8 else None) for i, row in enumerate(v)]


@pytest.mark.parametrize("case", ["plain", "tight", "odd", "few", "ties", "large"])
def test_codes_equal_brute_force(spark, case):
    rows = embedded(150, 16, 1, {"tight": 0.01}.get(case, 1.0))
    if case == "odd":
        rows = embedded(60, 13, 2)
        rows += [(200, None, 1), (-5, [float("nan")] * 13, 1), (-4, [None] + [0.0] * 12, 1), (-3, [float("inf")] * 13, None), (None, rows[3][1], 2), (7, rows[4][1], 1), (7, rows[4][1], 1), (300, [1.0, 2.0], 3), (301, [], None)]
    if case == "few":
        rows = rows[:5]
    if case == "ties":
        rows = [(i, [float(i % 3)] * 8, i % 2) for i in range(40)]
    if case == "large":
        rows[3] = (3, [3e9] * 16, 1)
        rows[4] = (4, [-float(np.float32(3e38))] * 16, 2)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS).repartition(3)
    assert in_order(map(tuple, codes.compress(df).collect())) == in_order(brute_codes(rows))


def test_codes_of_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compress(empty).count() == 0 == codes.compress(spark.createDataFrame([(1, None, 1, "c", 1)], VECTORS)).count()


def test_large_labels_are_summed_and_sent(spark, monkeypatch):
    monkeypatch.setattr(codes, "LARGE_LABEL", 30)
    rows = embedded(150, 16, 4)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    assert in_order(map(tuple, codes.compress(df).collect())) == in_order(brute_codes(rows))


@pytest.mark.parametrize(("entries", "dim", "spread"), [(256, 2, 0.05), (16, 8, 1.0), (1, 4, 1.0), (5, 3, 0.0)])
def test_tree_finds_the_nearest_entry_and_leaves_out_far_ones(entries, dim, spread):
    r = np.random.default_rng(5)
    e = np.floor(r.normal(0, 4096, (entries, dim)))
    e[-1] = e[0]
    x = np.floor(e[r.integers(0, entries, 2000)] + r.normal(0, 4096 * spread, (2000, dim)))
    index, best, computed = codes.nearest(codes.build(e.astype(object)), e, x)
    all_of = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (index == all_of.argmin(1)).all() and (best == all_of.min(1)).all()
    assert computed <= 2000 * entries and (entries < 256 or computed < 2000 * entries / 5)


# 13 repeated passages


def brute_repeats(rows, size):
    docs = [((1 << 63) if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for key, _, w in docs:
        for s in range(len(w) - size + 1):
            x = tuple(w[s : s + size])
            first[x] = min(first.get(x, (key, s)), (key, s))
    out = []
    for key, i, w in docs:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (key, s):
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def passages(seed, n=300):
    r = random.Random(seed)
    base = [str(r.randint(0, 9**6)) for _ in range(700)]
    rows = []
    for i in range(n):
        a, kind = r.randint(0, 600), r.random()
        if kind < 0.5:  # a passage that many share, between words of their own
            t = " ".join([f"u{i}_{k}" for k in range(r.randint(0, 6))] + base[100 : 100 + r.randint(18, 33)] + [f"v{i}_{k}" for k in range(10)])
        elif kind < 0.7:
            t = " ".join(base[a : a + r.randint(5, 50)] * r.randint(1, 3))
        elif kind < 0.8:
            t = " ".join(["a"] * r.randint(0, 60))
        elif kind < 0.9:
            t = " ".join(r.choice("ab") for _ in range(r.randint(0, 80)))
        else:
            t = r.choice([None, "", " \t", " \n".join(base), " ".join(base[:350]) + " new " + " ".join(base[350:])])
        rows.append((i % (n - 10) if r.random() < 0.95 else None, t))
    return [*rows, rows[5], rows[7], (n, "z" * 200_000 + " y"), (n + 1, "é 日本\x1c " * 40)]


@pytest.mark.parametrize("shard", [5000, 20])
@pytest.mark.parametrize(("size", "gram"), [(20, 8), (7, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, shard, size, gram):
    """Also with shards so small that frequent anchors are dealt into many and take a second turn."""
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "LARGE", 50)
    rows = passages(shard + size)
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, marks string, id int").repartition(5)
    assert in_order(map(tuple, repeats.remove_repeats(df, size, gram).collect())) == in_order(brute_repeats(rows, size))


@pytest.mark.parametrize("rows", [[], [(1, "")], [(1, None)], [(None, "a b")], [(1, "w " * 25), (2, "w " * 25)]])
def test_repeats_of_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert in_order(map(tuple, repeats.remove_repeats(df).collect())) == in_order(brute_repeats(rows, 20))


def test_automata_locate_all_but_the_first():
    texts = ["a b c d e f", "x b c d e y", "b c d e", "b"]
    text, place, again = repeats.locate(texts, np.array([1, 2, 1, 3]), np.array([0, 5, 40, 0]), 4)
    got = sorted(zip(text.tolist(), place.tolist(), again.tolist()))
    assert got == [(0, 0, False), (0, 1, False), (0, 2, False), (1, 0, False), (1, 1, True), (1, 2, False), (2, 0, True)]
    assert [len(x) for x in repeats.locate(["a b"], np.array([1]), np.array([0]), 4)] == [0, 0, 0]


# mended faults


@pytest.mark.parametrize("texts", [[""], [None], ["hi you"], ["a b c d e f", ""], ["one"], ["a b c"], ["a b c d"], ["x " * 1_300_000, "hi"], ["", "word " * 600_000, None]])
def test_short_portions_have_their_shingles(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in rows_of(neardup.near_duplicates(df))}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (want, i, True)
    assert neardup.keep_first(df).count() == len(texts)


def test_a_tie_of_languages_is_rejected(spark):
    rows = [(i, f"{'der die das und nicht' if i % 2 else 'the and not with this'} {i} {chr(97 + i % 26)}", "de" if i % 2 else "en") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, score, margin, rejected = model.predict("猫と犬")
    assert margin == 0 and rejected and not model.predict("the dog and the cat with this and not that")[3]


def test_rows_that_differ_in_a_map_stay_apart(spark):
    df = spark.sql("SELECT 1L doc_id, 'one two three' text, 'a' source, map('k', v) pairs, array(map(v, named_struct('m', map('x', v)))) deep FROM VALUES (1), (2), (3) t(v)")
    got = mixing.apply_mix(df.union(df.limit(1)))
    assert got.count() == 4 and {tuple(r["pairs"].items()) for r in got.collect()} == {(("k", 1),), (("k", 2),), (("k", 3),)}
    same = spark.sql("SELECT 1L doc_id, 'a' text, 's' source, map('p', 1, 'q', 2) pairs UNION ALL SELECT 1L, 'a', 's', map('q', 2, 'p', 1)")
    assert same.select(mixing._row_hash(same, 0)).distinct().count() == 1


def test_readers_of_a_version_survive_vacuum(spark, tmp_path):
    df = spark.range(40).withColumnRenamed("id", "doc_id").repartition(4)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(df)
    reader = store.read(df.schema)
    assert reader.count() == 40
    store.append(df)
    store.compact(df.schema, target=10**9, ratio=10**6)
    store.vacuum()
    assert reader.count() == 40 and store.read(df.schema, 1).count() == 40
    time.sleep(1.1)
    store.vacuum(grace=1)  # now the versions before the last are old enough
    assert store.read(df.schema).count() == 80 and len(list(tmp_path.glob("s/data/*/part-*"))) == len(store.shards())


def test_shards_of_a_column_called_metadata(spark):
    df = spark.range(20).selectExpr("id doc_id", "named_struct('file_path', 'x') _metadata", "'s' _shard")
    got = sharding.placed(df, target=10**9, ratio=10**6)
    assert got.count() == 20 and got.select("shard").distinct().count() == 1


def test_media_that_end_early_are_marked(spark):
    docs = spark.createDataFrame([(1, "some words " * 200), (2, None)], "doc_id long, text string")
    media = matroska.store_texts(docs)
    short = media.withColumn("media", F.expr("substring(media, 1, length(media) - 700)"))
    assert {r["whole"] for r in matroska.read_media(media).collect()} == {True}
    got = {r["doc_id"]: r["whole"] for r in matroska.read_media(short).collect()}
    assert got[1] is False
    assert "ends early" in {r["error"] for r in matroska.packets(short.where("doc_id = 1"), "doc_id", "media").collect()}


def test_every_labelled_text_teaches_its_language_whole(spark):
    rows = [(i, f"{'der die das und nicht' if i % 2 else 'the and not with this'} {chr(97 + i % 26)}", "de" if i % 2 else "en") for i in range(3000)]
    rows += [(3000 + i, "the and not with this " * 5000 + "zyxwvutsrq ponmlkjihg", "en") for i in range(2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"zyxwvutsrq" in model.samples["en"] and b"zyxwvutsrq" not in model.samples["de"]
    assert list(langid.units("ab " + "x" * 25))[:2] == ["ab", "xxxx"]
