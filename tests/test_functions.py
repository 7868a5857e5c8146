import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakequill.functions import text as tx

DIGITS = "零一二三四五六七八九"


def chinese(n: int) -> str:
    h, t, u = n // 100, n // 10 % 10, n % 10
    out = f"{DIGITS[h]}百" if h else ""
    if t:
        out += ("" if t == 1 and not h else DIGITS[t]) + "十"
    elif h and u:
        out += "零"
    return out + (DIGITS[u] if u else "")


def test_chinese_numbers_up_to_999(spark):
    df = spark.createDataFrame([(n, chinese(n)) for n in range(1, 1000)], "n bigint, c string")
    assert df.where(~F.col("n").eqNullSafe(tx.chinese_number(F.col("c")))).count() == 0


def test_column_letters_round_trip(spark):
    df = spark.range(1, 18279).select(F.col("id"), F.concat(tx.column_letters(F.col("id")), F.lit("7")).alias("ref"))
    assert df.where((tx.cell_column(F.col("ref")) != F.col("id")) | (tx.cell_row(F.col("ref")) != 7)).count() == 0


def packed(pieces, limit=800):
    out, cur, n = [], [], 0
    for raw in pieces:
        s = raw.strip()
        if not s:
            continue
        if n + len(s) < limit:
            cur.append(s)
            n += len(s) + 2
        else:
            if cur:
                out.append("\n\n".join(cur))
            cur, n = [s], len(s) + 2
    return out + (["\n\n".join(cur)] if cur else [])


def test_pack_against_a_loop(spark):
    seen = []

    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.text("ab \n", max_size=40), max_size=12))
    def collect(pieces):
        seen.append(pieces)

    collect()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(seen)], "i bigint, p array<string>")
    got = {r["i"]: [c["content"] for c in r["c"]] for r in df.select("i", tx.pack(F.col("p"), 30).alias("c")).collect()}
    assert got == {i: packed(p, 30) for i, p in enumerate(seen)}


def test_sentence_cut(spark):
    text = "甲" * 60 + "。\n" + "乙" * 60
    df = spark.createDataFrame([(text,), ("short",), ("x" * 200,), (None,)], "t string")
    got = [r[0] for r in df.select(tx.cut_at_sentence(F.col("t"), 100, 50)).collect()]
    assert got == ["甲" * 60 + "。\n", "short", "x" * 100 + "…", None]


@pytest.mark.parametrize("text,want", [("a-\nb", "ab"), ("x\n\n\n\ny", "x\n\ny"), ("x\n 12 \ny", "x\ny"), ("\x00a\x0b", "a"), (None, "")])
def test_clean(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.clean(F.col("t"))).first()[0] == want


def test_clear_empties_the_shared_folder(spark):
    from lakequill import session

    spark.range(3).write.parquet(session.fresh_dir(spark, "x"))
    session.clear(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{session.shared_dir(spark)}/lakequill")
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_terms_of_a_question_are_cut_as_texts_are(spark):
    from lakequill.functions import text as tx

    for t in ("合同金额是多少 in 2024年", "Plain words, a b cd_1", "签", "Ünïcode слова 日本語text", "。。"):
        got = spark.createDataFrame([(t,)], "t string").select(tx.tokens(F.lower(F.col("t"))).alias("x")).first()["x"]
        assert tx.query_terms(t) == (list(dict.fromkeys(got)) or [t])


def test_steps_end_at_the_first_that_fails(spark):
    from lakequill.operators import extras

    df, told = extras.apply_all(spark.range(5), [("a", lambda d: d.where("id > 1")), ("b", lambda d: d.select("none")), ("c", lambda d: d.limit(1))])
    assert df.count() == 3 and [(t["step"], t["success"]) for t in told] == [("a", True), ("b", False)]
    late = lambda d: d.withColumn("x", F.when(F.col("id") == 4, F.raise_error(F.lit("four"))).otherwise(F.lit("")))
    df, told = extras.apply_all(spark.range(5), [("a", lambda d: d.where("id > 1")), ("b", late), ("c", lambda d: d.limit(1))])
    assert df.count() == 3 and [(t["success"], t["rows"]) for t in told] == [(True, 3), (False, None)] and "four" in told[1]["message"]


def test_commands_edit_cells_and_paragraphs(spark, tmp_path):
    from lakequill.api import Workspace

    w = Workspace(spark, f"file://{tmp_path}/w")
    cells = spark.createDataFrame([("Sheet1", r, c, f"{r}{c}") for r in (1, 2, 3) for c in (1, 2)] + [("other", 2, 1, "x")], "sheet string, row bigint, col bigint, value string")
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert ("Sheet1", 2, 2, "新值") in read(w.operate(cells, "把B2改为新值"))
    assert read(w.operate(cells, "删除第二行")) == [("Sheet1", 1, 1, "11"), ("Sheet1", 1, 2, "12"), ("Sheet1", 2, 1, "31"), ("Sheet1", 2, 2, "32"), ("other", 2, 1, "x")]
    assert read(w.operate(cells, "删除第1列"))[0] == ("Sheet1", 1, 1, "12")
    assert ("Sheet1", 2, 2, "乙") in read(w.operate(cells, "插入第二行，内容为甲，乙")) and ("Sheet1", 4, 2, "32") in read(w.operate(cells, "插入第二行，内容为甲，乙"))
    assert ("Sheet1", 1, 2, "新列") in read(w.operate(cells, "插入第二列，内容为新列"))
    marked = w.operate(cells, "把数值大于20的标红")
    assert {r["value"]: r["style"] for r in marked.collect()}["31"] == "FF0000"
    heads = spark.createDataFrame([(1, 0, "h", 1), (1, 1, "body", 0), (1, 2, "h2", 2)], "doc_id bigint, ordinal bigint, text string, level int")
    assert [r["text"] for r in w.operate(heads, "删除第二个标题").orderBy("ordinal").collect()] == ["h", "body"]
    with pytest.raises(ValueError, match="not understood"):
        w.operate(cells, "天气如何")
